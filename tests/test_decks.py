"""Slide archives: order of slides, nested groups, tables, notes, broken files, files on disk."""

import deck_files as d

from loam.sources import decks


def found(spark, content):
    rows = decks.blocks(spark.createDataFrame([("x", content)], "path string, content binary")).collect()
    return [(r.slide, r.kind, r.block_id, r.row, r.col, r.text) for r in rows]


def test_shapes_tables_and_notes(spark):
    first = d.box(2, d.run("Spend ") + d.run("$5"), " ", d.run(" up "), at=d.place(1, 2, 3, 4)) + d.group(d.group(d.box(4, d.run("deep"))), d.box(5, d.run("flat")))
    second = d.table(7, [["Metric", "Value"], [" ", "5%"]]) + d.box(8, '<a:fld><a:t>field</a:t></a:fld><a:br/>') + d.box(9, d.run("  "))
    assert found(spark, d.archive([(first, "say it"), (second, None), ("", " ")])) == [
        (1, "text", "1:2", None, None, "Spend $5\nup"), (1, "text", "1:4", None, None, "deep"), (1, "text", "1:5", None, None, "flat"), (1, "notes", "1:notes", None, None, "say it"),
        (2, "cell", "2:7", 0, 0, "Metric"), (2, "cell", "2:7", 0, 1, "Value"), (2, "cell", "2:7", 1, 1, "5%"), (2, "text", "2:8", None, None, "field"),
    ]


def test_places(spark):
    shapes = d.box(2, d.run("a"), at=d.place(1, 2, 3, 4)) + d.box(3, d.run("b"))
    rows = decks.blocks(spark.createDataFrame([("x", d.archive([(shapes, None)]))], "path string, content binary")).collect()
    assert [(r.left, r.top, r.width, r.height) for r in rows] == [(1, 2, 3, 4), (None,) * 4]


def test_broken_and_empty(spark):
    assert [r[1] for r in found(spark, b"no archive")] == ["broken"]
    assert [r[1] for r in found(spark, None)] == ["broken"]
    assert [r[1] for r in found(spark, d.archive([])[:40])] == ["broken"]
    assert found(spark, d.archive([])) == []
    assert decks.blocks(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"deck.{i}.pptx").write_bytes(d.archive([(d.box(2, d.run(f"text {i}")), None)]))
    (tmp_path / "other.txt").write_bytes(b"x")
    assert sorted((r.deck_id, r.text) for r in decks.read_decks(spark, str(tmp_path)).collect()) == [(f"deck.{i}", f"text {i}") for i in range(3)]
