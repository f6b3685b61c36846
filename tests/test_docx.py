"""Word packages built in memory: reading, rewriting, whole runs of the program's two commands."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.plans import documents
from maskwright.sources import docx

TODAY = dt.date(2026, 1, 1)
NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:wp="http://x/wp" xmlns:w14="http://x/w14" mc:Ignorable="w14"'
TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'
RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def p(*runs, extra=""):
    return "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{t}</w:t></w:r>' for t in runs) + extra + "</w:p>"


def box(text):
    return f"<w:txbxContent>{p(text)}</w:txbxContent>"


def package(body, rels="", **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", TYPES)
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", RELS.format(rels))
        for name, content in parts.items():
            z.writestr(f"word/{name}.xml", content)
    return out.getvalue()


SECTION = '<w:sectPr><w:headerReference w:type="default" r:id="h1"/><w:footerReference w:type="first" r:id="h1"/></w:sectPr>'
HEADER = '<Relationship Id="h1" Target="header1.xml"/>'


def test_containers_in_order_and_by_story():
    nested = f"<w:tbl><w:tr><w:tc>{p('deep')}</w:tc></w:tr></w:tbl>"
    both = f"<w:r><mc:AlternateContent><mc:Choice>{box('same')}</mc:Choice><mc:Fallback>{box('same')}</mc:Fallback></mc:AlternateContent></w:r>"
    odd = f"<w:r><mc:AlternateContent><mc:Choice>{box('one')}</mc:Choice><mc:Fallback>{box('two')}</mc:Fallback></mc:AlternateContent></w:r>"
    link = '<w:hyperlink r:id="x"><w:r><w:t>linked</w:t><w:tab/><w:br/></w:r></w:hyperlink>'
    body = p("a", "", "b", extra=link) + f"<w:tbl><w:tr><w:tc>{p('cell')}{nested}</w:tc></w:tr></w:tbl>" + p("c", extra=both + odd + f"<w:r>{box('single')}</w:r>") + SECTION + SECTION
    rows = docx.containers_of(package(body, HEADER, header1=f"<w:hdr {NS}>{p('top')}</w:hdr>"))
    assert [(r["container_id"], r["story_type"].split("_")[0], r["text"], len(r["mirrors"]), r["rewrite_safe"]) for r in rows] == [
        ("body/p0000", "BODY", "ablinked\t\n", 0, True),
        ("body/t0000/r0000/c0000/p0000", "TABLE", "cell", 0, True),
        ("body/t0000/r0000/c0000/t0000/r0000/c0000/p0000", "TABLE", "deep", 0, True),
        ("body/p0001", "BODY", "c", 0, True),
        ("body/p0001/txb0000/p0000", "TEXT", "same", 1, True),
        ("body/p0001/txb0001/choice/p0000", "TEXT", "one", 0, False),
        ("body/p0001/txb0002/fallback/p0000", "TEXT", "two", 0, False),
        ("body/p0001/txb0003/p0000", "TEXT", "single", 0, True),
        ("header:/word/header1.xml:default/p0000", "HEADER", "top", 0, True),
    ]
    assert rows[0]["run_texts"] == ["a", "", "b", "linked\t\n"]


def test_rewriting_keeps_runs_and_declarations():
    content = package(p("x one", " two y"))
    new = docx.rewritten(content, {"body/p0000": (["x NEW\t", " y"], [])})
    assert docx.containers_of(new)[0]["run_texts"] == ["x NEW\t", " y"]
    assert b'mc:Ignorable="w14"' in zipfile.ZipFile(io.BytesIO(new)).read("word/document.xml")
    assert docx.validated(new)["xml_parts_validated"] == 3
    with pytest.raises(docx.PackageError):
        docx.validated(b"no zip")


def test_scan_and_redact_a_letter(spark, tmp_path):
    link = '<Relationship Id="m" TargetMode="External" Target="mailto:Maya.Stone%40corp.example.org?subject=x"/>'
    body = p("Contact Person: Maya ", "Stone") + p("Write to maya.stone@corp.example.org, SSN 123-45-6789. Ticket 4711.") + p("Acme Widgets Private Limited") + SECTION
    source, out = tmp_path / "in.docx", tmp_path / "out.docx"
    source.write_bytes(package(body, HEADER + link, header1=f"<w:hdr {NS}>{p('card 4111 1111 1111 1111')}</w:hdr>"))
    before = source.read_bytes()
    found = documents.scan_report(spark, str(source), today=TODAY)
    assert {k: v["accepted"] for k, v in found["detections_by_type"].items() if v["accepted"]} == {"PERSON": 1, "EMAIL": 1, "COMPANY": 1, "SSN": 1, "CREDIT_CARD": 1}
    assert found["detections_by_type"]["PERSON"]["cross_run"] == 1
    report = documents.redact(spark, str(source), str(out), b"0123456789abcdef", today=TODAY)
    assert source.read_bytes() == before and report["applied_replacement_count"] == 5 and report["external_relationship_update_count"] == 1
    assert report["residual_supported_text_scan"]["review_required_count"] == 0
    text = "\n".join(r["text"] for r in docx.containers_of(out.read_bytes()))
    assert "Ticket 4711." in text
    for value in ("Maya", "Stone", "123-45-6789", "4111 1111", "Acme", "corp.example.org"):
        assert value not in text and value not in str(docx.external_targets(out.read_bytes())) and value not in str(report)
    with pytest.raises(docx.PackageError):
        docx.write_atomically(before, str(source), str(source))


def test_data_source(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(p("one") + p("two")))
    spark.dataSource.register(docx.DocxSource)
    got = spark.read.format("docx").load(str(tmp_path)).orderBy("seq")
    assert [r["text"] for r in got.collect()] == ["one", "two"]
    assert docx.text_containers(docx.read_docx(spark, str(tmp_path))).count() == 2


def test_refused_packages_have_an_error_and_unchanged_ones_stay(spark, tmp_path):
    sound, other = package(p("one") + p("two")), package(p("three"))
    for name, content in (("a", sound), ("b", other), ("c", b"no package"), ("d", sound + b"x" * 5_000)):
        (tmp_path / f"{name}.docx").write_bytes(content)
    read = docx.read_docx(spark, str(tmp_path), most_bytes=len(sound) + 100)
    rows = {r["source"].rsplit("/")[-1]: r for r in read.collect()}
    assert rows["a.docx"]["error"] is None and rows["a.docx"]["content"] == sound
    assert rows["c.docx"]["content"] is None and "PackageError" in rows["c.docx"]["error"]
    assert rows["d.docx"]["content"] is None and "bytes" in rows["d.docx"]["error"]
    containers = docx.text_containers(read)
    assert sorted(r["text"] for r in containers.collect()) == ["one", "three", "two"]
    changed = containers.where("text = 'one'").withColumn("run_texts", F.array(F.lit("ONE")))
    new = docx.text_containers(docx.rewritten_packages(read.where("error is null"), changed))
    assert sorted(r["text"] for r in new.collect()) == ["ONE", "three", "two"]
