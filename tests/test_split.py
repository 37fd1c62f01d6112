"""Splitting foreign exports: notes, header and footer stay as they are."""

import pytest

from noteweave.operators.order import first_rows
from noteweave.plans import jobs
from noteweave.sources.enex import note_blocks, read_enclosure, read_enex_header

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<!-- kept -->\n<en-export\n  export-date="20240131T000000Z"\n  application="Other"\n  version="9.1">\n'
TAIL = "\n<!-- also kept -->\n</en-export>\n"


def foreign(n: int) -> str:
    return (
        f"<note>\n <title>Nöte {n} &amp; more</title>\n <content><![CDATA[<en-note>line\n{n}</en-note>]]></content>\n"
        f"  <note-attributes><latitude>1.{n}</latitude><reminder-order>{n}</reminder-order></note-attributes>"
        f'<resource><data encoding="base64">QUJD{"x" * n}</data><mime>image/png</mime></resource></note>'
    )


def written(path, notes, head=HEAD, tail=TAIL):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(head + "\n".join(notes) + tail, encoding="utf-8")
    return str(path)


def part_texts(folder):
    assert all(p.is_file() for p in folder.iterdir())
    return [p.read_text() for p in sorted(folder.glob("*.enex"))]


@pytest.mark.parametrize("split_bytes", ["128m", "700"])
def test_notes_are_copied_byte_for_byte(spark, tmp_path, split_bytes):
    blocks = [foreign(n) for n in range(23)]
    path = written(tmp_path / "in" / "other.enex", blocks)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        got = [r["block"] for r in note_blocks(spark, path).orderBy("row_idx").collect()]
        assert got == blocks and read_enclosure(spark, path) == (HEAD, TAIL)
        manifest = jobs.split(spark, path, str(tmp_path / "out"), 10).orderBy("part_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(m.file_name, m.notes, m.quarantined) for m in manifest] == [(f"other_part00{n}.enex", k, 0) for n, k in ((1, 10), (2, 10), (3, 3))]
    want = [HEAD + "\n".join(blocks[at : at + 10]) + TAIL + "\n" for at in (0, 10, 20)]
    assert part_texts(tmp_path / "out" / "parts") == want


def test_malformed_notes_are_set_aside_and_counted(spark, tmp_path):
    bad = "<note><title>C <b></title></note>"
    path = written(tmp_path / "in" / "x.enex", [foreign(0), bad, foreign(1), "<note/><note><title>ok</title></note>"])
    manifest = jobs.split(spark, path, str(tmp_path / "out"), 2).orderBy("part_no").collect()
    quarantined = spark.read.parquet(str(tmp_path / "out" / "quarantine")).collect()
    assert [r["block"] for r in quarantined if r["block"] == bad] == [bad]
    assert {m.quarantined for m in manifest} == {len(quarantined)} and foreign(1) in part_texts(tmp_path / "out" / "parts")[0]


def test_root_attributes_on_several_lines(spark, tmp_path):
    path = written(tmp_path / "a.enex", [foreign(0)])
    assert read_enex_header(spark, path) == {"export_date": "20240131T000000Z", "application": "Other", "version": "9.1"}


def test_an_export_without_notes_is_an_error(spark, tmp_path):
    path = written(tmp_path / "b.enex", [])
    with pytest.raises(ValueError):
        jobs.split(spark, path, str(tmp_path / "out"))


def test_no_limit_keeps_all_rows(spark):
    rows = spark.range(3).withColumnRenamed("id", "row_idx").selectExpr("row_idx + 2000000 AS row_idx")
    assert first_rows(rows).count() == 3 and first_rows(rows, 2_000_001).count() == 1
