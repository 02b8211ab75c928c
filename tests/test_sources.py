import io
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.operators import chunk, patch
from weftline.sources import detect, extract, guards
from weftline.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sentences_join_abbreviations(spark):
    assert one(spark, chunk.sentences(F.lit("Dr. Smith came. He left!  \"Why?\" No."))) == ["Dr. Smith came.", "He left!", '"Why?" No.']


def test_pack_and_undersized(spark):
    units = F.array(*map(F.lit, ["aaa", "bb", "cccccccccc", "d"]))
    assert one(spark, chunk.pack(units, 8, "--")) == ["aaa--bb", "cccccccccc", "d"]
    assert one(spark, chunk.merge_undersized(units, 4, 12)) == ["aaa\n\nbb", "cccccccccc", "d"]
    assert one(spark, chunk.merge_undersized(F.array(F.lit("long enough"), F.lit("x")), 4, 20)) == ["long enough\n\nx"]


def test_windows_cover_the_text():
    text = " ".join(f"word{i}" for i in range(500))
    pieces = chunk.windows(text, 100, 20)
    assert all(len(p) <= 100 for p in pieces) and pieces[-1].endswith("word499")
    assert set(text.split()) <= {w for p in pieces for w in p.split()}
    assert len(chunk.windows("x" * 1000, 50, 60)) < 50 < len(chunk.windows("x" * 1000, 50, 60, clamp=False))


def test_parsers():
    assert [(s["title"], s["content"]) for s in extract.parse_markdown("pre\n# A\n```\n# no\n```\n## B\nx")[1]] == [(None, "pre"), ("A", "# A\n```\n# no\n```"), ("B", "## B\nx")]
    assert extract.delimited_rows('a"b"c,"x\n""y"\r\n\n', ",") == [["abc", 'x\n"y'], [""]][:1]
    title, sections = extract.parse_html("<title>T</title><nav><li>n</nav><h1>H</h1><p>one<p>two<ul><li>x</ul><table><tr><td>a<td>b</table><script>1</script>")
    assert title == "T" and sections[0]["content"] == "H\n\none\n\ntwo\n\n- x\n\na | b"
    assert [s["section"] for s in extract.parse_json('{"b": 1, "a": [2]}')[1]] == ["$.b", "$.a"]
    with pytest.raises(ValueError):
        extract.parse_xml('<!DOCTYPE a [<!ELEMENT a ANY><!ENTITY x "y">]><a/>')


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<x/>")
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_formats():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>'
    assert extract.parse_docx(archive(**{"word/document.xml": doc}))[1][0]["content"] == "Head\n\nbody"
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {s}><sheetData><row><c t="inlineStr"><is><t>h</t></is></c></row><row><c><f>A1</f><v>2</v></c></row></sheetData></worksheet>'
    assert extract.parse_xlsx(archive(**{"xl/worksheets/sheet1.xml": sheet}))[1][0]["content"] == "h: 2 (formula: A1)"
    with pytest.raises(ValueError):
        extract.open_archive(archive(**{"word/x": "0" * 1_000_000}))


def test_errors_stay_in_their_row(spark):
    rows = spark.createDataFrame([(1, "{"), (2, "[1]"), (3, None)], "i int, t string").select("i", extract.extract(F.col("t"), "json").alias("x")).orderBy("i").collect()
    assert [(bool(r.x.error), len(r.x.sections)) for r in rows] == [(True, 0), (False, 1), (False, 0)]


def test_guards(spark):
    rows = spark.createDataFrame([("::1",), ("2606:4700::1111",), ("::ffff:10.0.0.1",), ("fe80::1",), ("bad",)], "a string").select(guards.disallowed_ipv6(F.col("a")).alias("x"))
    assert [r.x for r in rows.collect()] == [True, False, True, True, True]
    assert one(spark, guards.disallowed_ipv4(F.lit("8.8.8.8"))) is False and one(spark, guards.disallowed_ipv4(F.lit("8.8.8"))) is True
    assert one(spark, guards.defused(F.lit("=1+1"))) == "'=1+1"


def test_ambiguous_and_tolerant(spark):
    row = spark.createDataFrame([(bytearray(b"ok \xff" + b"x" * 99),)], "c binary")
    text, error = detect.decode(F.col("c"), tolerant=True)
    assert row.select(text.alias("t"), error.alias("e")).first().t.startswith("ok �x")


def test_patch_is_all_or_nothing():
    assert patch.apply_patch('{"a":[1]}', '[{"op":"add","path":"/a/9","value":2},{"op":"copy","from":"/zz","path":"/c"}]') == ('{"a":[1,2]}', None, None)
    assert patch.apply_patch('{"a":1}', '[{"op":"replace","path":"/b","value":2},{"op":"remove","path":"/x"}]')[:2] == (None, 1)


def test_stream_equals_table(spark, tmp_path):
    rows = spark.range(500).selectExpr("id as event_id", "timestamp_seconds(id * 60) as ts", "id % 5 as user_id", "case when id % 2 = 0 then 'a' else 'b' end as event_type", "cast(id as double) as value", "'' as props")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    query = events.tumbling(events.read(spark, str(tmp_path / "in"), 10)).writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, events.tumbling(rows).collect()))
