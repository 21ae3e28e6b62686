"""Collections read in ranges against the reader of whole files."""

from __future__ import annotations

import json
import random

import pytest

from sciobs.plans.spec import SpecError
from sciobs.sources import files
from sciobs.sources import geojson_ranges as gr


def plain(raw, state):
    """Brackets outside strings, byte by byte."""
    at, signs = [], []
    for i, c in enumerate(raw):
        if state == gr.ESCAPED:
            state = gr.STRING
        elif state == gr.STRING:
            state = gr.ESCAPED if c == 0x5C else gr.BETWEEN if c == 0x22 else gr.STRING
        elif c == 0x22:
            state = gr.STRING
        elif c in b"{[]}":
            at.append(i)
            signs.append(1 if c in b"{[" else -1)
    return at, signs, state


def test_brackets_against_a_scan():
    r = random.Random(3)
    for _ in range(400):
        text = json.dumps([r.choice(['a"b', "\\", '\\"', "{[", "]}\\\\", "é", {"k\\": ['"']}, 1, [], {}]) for _ in range(r.randrange(8))]).encode()
        cut = r.randrange(len(text) + 1)
        at, signs, state = gr.brackets(text[:cut], gr.BETWEEN)
        assert (at.tolist(), signs.tolist(), state) == plain(text[:cut], gr.BETWEEN)
        at, signs, end = gr.brackets(text[cut:], state)
        assert (at.tolist(), signs.tolist(), end) == plain(text[cut:], state)


def collections():
    r = random.Random(5)
    feature = lambda i: {"type": "Feature", "id": i, "properties": {"note": r.choice(['say "hi"', "back\\", "]}{[", "ü日", "", 'tail\\"'])}, "geometry": r.choice([None, {"type": "Point", "coordinates": [i, -i]}, {"type": "Polygon", "coordinates": [[[0, 0], [i + 1, 0], [0, 2], [0, 0]]]}])}
    many = [feature(i) for i in range(60)]
    return {
        "a": json.dumps({"type": "FeatureCollection", "bbox": [0, 0, 1, 1], "others": [{"type": "Feature", "x": [{}]}], "features": many, "more": [{"y": "features"}]}),
        "b": json.dumps({"type": "FeatureCollection", "name": '"features": [', "features": many[:7]}, indent=3, ensure_ascii=False), "c": json.dumps({"type": "FeatureCollection", "features": []}), "d": json.dumps({"features": many[:1], "type": "FeatureCollection"}),
    }


def test_ranges_of_all_lengths_equal_whole_files(spark, tmp_path):
    for name, text in collections().items():
        (tmp_path / f"{name}.geojson").write_text(text, encoding="utf-8")
    key = lambda rows: sorted((x["file_path"].rpartition("/")[2], x["feature_index"], x["id"], str(x["properties"]), bytes(x["geometry"] or b""), x["max_x"]) for x in rows)
    want = key(files.read_geojson(spark, f"{tmp_path}/*.geojson").collect())
    assert len(want) == 68
    for size in (37, 1000, 1 << 20):
        assert key(gr.read_large_geojson(spark, f"{tmp_path}/*.geojson", size).collect()) == want, size
    with pytest.raises(SpecError):
        gr.read_large_geojson(spark, str(tmp_path), 0)
