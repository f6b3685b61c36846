"""Word packages as tables of text containers, and rewritten packages back.

A package is read and changed with the standard library alone. Its trees keep prefixes
and declarations as they are, and parts that don't change are copied byte for byte.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from xml.dom import minidom
from xml.parsers.expat import ExpatError

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.types import CONTAINERS

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

# What a run may hold to be rewritten, required parts, audited attributes, and size of uploads.
SAFE_TAGS = ("rPr", "t", "tab", "br", "cr", "noBreakHyphen")
REQUIRED = ("[Content_Types].xml", "word/document.xml")
SHAPE_ELEMENTS, SHAPE_ATTRIBUTES = ("docPr", "cNvPr", "shape", "imagedata"), ("alt", "descr", "title", "name")
RASTER = (".bmp", ".gif", ".jpeg", ".jpg", ".png", ".tif", ".tiff")
UNSUPPORTED = ("word/comments.xml", "word/endnotes.xml", "word/footnotes.xml")
MOST_BYTES = 10 * 1024 * 1024


class PackageError(ValueError):
    """Not a package that can be read or written."""


def _is(node, name: str, space: str = W) -> bool:
    return node.nodeType == node.ELEMENT_NODE and node.localName == name and node.namespaceURI == space


def _children(node, *names: str, space: str = W) -> list:
    return [c for c in node.childNodes if any(_is(c, n, space) for n in names)]


def _walk(node, name: str, space: str = W, stop: str | None = None) -> Iterator:
    """Elements of a name below node in document order; not below elements named stop, nor those of the name itself if it is stop."""
    for child in node.childNodes:
        if child.nodeType != child.ELEMENT_NODE:
            continue
        if _is(child, name, space):
            yield child
        if stop is None or not _is(child, stop):
            yield from _walk(child, name, space, stop)


def _runs(paragraph) -> list:
    return list(_walk(paragraph, "r", stop="p"))


def _run_text(run) -> str:
    out = []
    for c in run.childNodes:
        if _is(c, "t"):
            out.append("".join(t.data for t in c.childNodes if t.nodeType in (t.TEXT_NODE, t.CDATA_SECTION_NODE)))
        elif _is(c, "tab") or _is(c, "ptab"):
            out.append("\t")
        elif _is(c, "cr") or (_is(c, "br") and c.getAttributeNS(W, "type") in ("", "textWrapping")):
            out.append("\n")
        elif _is(c, "noBreakHyphen"):
            out.append("-")
    return "".join(out)


def _set_run_text(run, text: str) -> None:
    document = run.ownerDocument
    for c in list(run.childNodes):
        if not _is(c, "rPr"):
            run.removeChild(c)
    prefix = run.prefix + ":" if run.prefix else ""
    for piece in re.findall(r"\t|\n|[^\t\n]+", text):
        if piece == "\t" or piece == "\n":
            run.appendChild(document.createElementNS(W, prefix + ("tab" if piece == "\t" else "br")))
            continue
        t = run.appendChild(document.createElementNS(W, prefix + "t"))
        if piece != piece.strip():
            t.setAttribute("xml:space", "preserve")
        t.appendChild(document.createTextNode(piece))


class Container:
    """A paragraph with its mirrors, in the trees of an open package."""

    def __init__(self, container_id: str, story: str, paragraphs: list, safe: bool = True):
        self.container_id, self.story, self.safe = container_id, story, safe
        self.runs = [_runs(p) for p in paragraphs]

    def row(self, seq: int) -> dict:
        texts = [[_run_text(r) for r in runs] for runs in self.runs]
        unsafe = [k for runs in self.runs for k, r in enumerate(runs) if any(c.nodeType == c.ELEMENT_NODE and not any(_is(c, t) for t in SAFE_TAGS) for c in r.childNodes)]
        return {
            "container_id": self.container_id, "seq": seq, "story_type": self.story, "text": "".join(texts[0]), "run_texts": texts[0], "mirrors": texts[1:],
            "rewrite_safe": self.safe, "unsafe_runs": sorted(set(unsafe)), "ner": [],
        }


def _box_paragraphs(box) -> list:
    return [p for p in _walk(box, "p", stop="txbxContent")]


def _boxes(paragraph, base: str) -> Iterator[Container]:
    """Text boxes of a paragraph. Two branches that say the same are one container with a mirror."""
    number = 0

    def alone(contents: list, name: str) -> Iterator[Container]:
        for k, box in enumerate(contents):
            for i, p in enumerate(_box_paragraphs(box)):
                yield Container(f"{base}/txb{number + k:04d}/{name}/p{i:04d}", "TEXT_BOX_PARAGRAPH", [p], False)

    in_alternates: set[int] = set()
    for alternate in _walk(paragraph, "AlternateContent", MC):
        branches = [[*_children(alternate, name, space=MC)] for name in ("Choice", "Fallback")]
        held = [[list(_walk(b, "txbxContent")) for b in side] for side in branches]
        in_alternates.update(id(box) for side in held for boxes in side for box in boxes)
        if len(branches[0]) != 1 or len(branches[1]) != 1:
            named = [(boxes, f"branch{k:02d}") for k, boxes in enumerate([*held[0], *held[1]])]
        elif len(held[0][0]) != len(held[1][0]):
            named = [(held[0][0], "choice"), (held[1][0], "fallback")]
        else:
            named = []
            for first, second in zip(held[0][0], held[1][0], strict=True):
                pairs = (_box_paragraphs(first), _box_paragraphs(second))
                said = [["".join(map(_run_text, _runs(p))) for p in side] for side in pairs]
                if said[0] != said[1]:
                    for boxes, name in (([first], "choice"), ([second], "fallback")):
                        yield from alone(boxes, name)
                        number += 1
                    continue
                for i, both in enumerate(zip(*pairs, strict=True)):
                    yield Container(f"{base}/txb{number:04d}/p{i:04d}", "TEXT_BOX_PARAGRAPH", list(both))
                number += 1
        for boxes, name in named:
            yield from alone(boxes, name)
            number += len(boxes)
    for box in _walk(paragraph, "txbxContent"):
        if id(box) not in in_alternates:
            for i, p in enumerate(_box_paragraphs(box)):
                yield Container(f"{base}/txb{number:04d}/p{i:04d}", "TEXT_BOX_PARAGRAPH", [p])
            number += 1


def _story(parent, prefix: str, story: str, in_tables: str) -> Iterator[Container]:
    """Paragraphs and tables directly below parent, tables cell by cell."""
    p = t = 0
    for block in _children(parent, "p", "tbl"):
        if _is(block, "p"):
            yield Container(f"{prefix}/p{p:04d}", story, [block])
            yield from _boxes(block, f"{prefix}/p{p:04d}")
            p += 1
            continue
        for row, tr in enumerate(_children(block, "tr")):
            for cell, tc in enumerate(_children(tr, "tc")):
                yield from _story(tc, f"{prefix}/t{t:04d}/r{row:04d}/c{cell:04d}", in_tables, in_tables)
        t += 1


class Package:
    """An open package: parts as bytes, the parsed trees of those that were looked at."""

    def __init__(self, content: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if (bad := z.testzip()) is not None:
                    raise PackageError(f"corrupt member {bad}")
                self.infos = z.infolist()
                self.parts = {i.filename: z.read(i) for i in self.infos}
        except (zipfile.BadZipFile, zipfile.LargeZipFile) as e:
            raise PackageError("not a Word package") from e
        if missing := [n for n in REQUIRED if n not in self.parts]:
            raise PackageError(f"missing parts: {missing}")
        self.trees: dict[str, minidom.Document] = {}

    def tree(self, name: str) -> minidom.Document:
        if name not in self.trees:
            try:
                self.trees[name] = minidom.parseString(self.parts[name])
            except ExpatError as e:
                raise PackageError(f"{name} is not well-formed") from e
        return self.trees[name]

    def relations(self, part: str) -> list:
        head, _, tail = part.rpartition("/")
        name = f"{head}/_rels/{tail}.rels" if head else f"_rels/{tail}.rels"
        return list(self.tree(name).documentElement.childNodes) if name in self.parts else []

    def external(self) -> list:
        """External relationship elements of all parts but the package's own."""
        names = sorted(n for n in self.parts if n.endswith(".rels") and n != "_rels/.rels")
        return [r for n in names for r in self.tree(n).documentElement.childNodes if r.nodeType == r.ELEMENT_NODE and r.getAttribute("TargetMode") == "External"]

    def containers(self) -> list[Container]:
        body = _children(self.tree("word/document.xml").documentElement, "body")[0]
        out = list(_story(body, "body", "BODY_PARAGRAPH", "TABLE_CELL_PARAGRAPH"))
        targets = {r.getAttribute("Id"): r.getAttribute("Target") for r in self.relations("word/document.xml") if r.nodeType == r.ELEMENT_NODE}
        sections = [s for p in _children(body, "p") for pr in _children(p, "pPr") for s in _children(pr, "sectPr")] + _children(body, "sectPr")
        seen: set[str] = set()
        for section in sections:
            for kind in ("header", "footer"):
                references = {r.getAttributeNS(W, "type") or "default": r.getAttributeNS(R, "id") for r in _children(section, f"{kind}Reference")}
                for variant in ("default", "first", "even"):
                    target = targets.get(references.get(variant, ""), "")
                    part = target.lstrip("/") if target.startswith("/") else f"word/{target}"
                    if not target or part in seen or part not in self.parts:
                        continue
                    seen.add(part)
                    story = f"{kind.upper()}_PARAGRAPH"
                    out += _story(self.tree(part).documentElement, f"{kind}:/{part}:{variant}", story, story)
        return out

    def saved(self) -> bytes:
        """The package with its changed trees; parts without one as they were."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for info in self.infos:
                tree = self.trees.get(info.filename)
                z.writestr(info.filename, tree.toxml(encoding="UTF-8", standalone=True) if tree is not None else self.parts[info.filename])
        return out.getvalue()


def containers_of(content: bytes) -> list[dict]:
    """Rows of a package's containers, in order."""
    return [c.row(k) for k, c in enumerate(Package(content).containers())]


def rewritten(content: bytes, runs: dict[str, tuple[list[str], list[list[str]]]], targets: dict[str, str] | None = None) -> bytes:
    """The package with new run texts (of the container and of its mirrors) by container, and external targets exchanged.

    What is saved is opened again: its containers must be the same, with the texts asked for.
    """
    package = Package(content)
    for c in package.containers():
        if c.container_id in runs:
            new = [runs[c.container_id][0], *runs[c.container_id][1]]
            for own, texts in zip(c.runs, new, strict=True):
                for run, text in zip(own, texts, strict=True):
                    if _run_text(run) != text:
                        _set_run_text(run, text)
    for r in package.external():
        if (target := (targets or {}).get(r.getAttribute("Target"))) is not None:
            r.setAttribute("Target", target)
    saved = package.saved()
    before, after = {c["container_id"]: c for c in containers_of(content)}, {c["container_id"]: c for c in containers_of(saved)}
    if set(before) != set(after) or any(len(before[k]["run_texts"]) != len(after[k]["run_texts"]) for k in before):
        raise PackageError("containers or runs changed while saving")
    if any(after[k]["text"] != "".join(v[0]) for k, v in runs.items()):
        raise PackageError("the saved text is not the planned one")
    return saved


def validated(content: bytes) -> dict:
    package = Package(content)
    names = [n for n in package.parts if n.endswith((".xml", ".rels"))]
    for n in names:
        package.tree(n)
    return {"zip_integrity_valid": True, "required_parts_present": True, "xml_parts_validated": len(names)}


def unsupported_content(content: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
    return {
        "raster_image_count": sum(n.startswith("word/media/") and n.lower().endswith(RASTER) for n in names), "unsupported_story_part_count": sum(n in UNSUPPORTED for n in names),
        "embedded_object_count": sum(n.startswith("word/embeddings/") for n in names),
    }


def shape_metadata(content: bytes) -> list[tuple[str, str, str]]:
    """(part, attribute, value) of drawings' names and descriptions that aren't blank."""
    package, out = Package(content), []
    for part in sorted(n for n in package.parts if n.startswith("word/") and n.endswith(".xml")):
        for e in package.tree(part).getElementsByTagName("*"):
            if e.localName in SHAPE_ELEMENTS:
                attributes = [e.attributes.item(k) for k in range(e.attributes.length)]
                out += [(part, a.localName, a.value.strip()) for a in attributes if a.localName in SHAPE_ATTRIBUTES and a.value.strip()]
    return out


def external_targets(content: bytes) -> list[str]:
    return [r.getAttribute("Target") for r in Package(content).external()]


def read_docx(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id (SHA-256 of the package), source, content and error of the packages under path.

    A file of more than most_bytes, or one that is no sound package, has an error in
    place of its content; the others' jobs go on.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)

    @F.pandas_udf("string")
    def fault(contents: pd.Series) -> pd.Series:
        return pd.Series([_fault(bytes(c)) for c in contents], dtype=object)

    small = files.where(F.col("length") <= most_bytes).withColumn("error", fault("content"))
    large = files.where(F.col("length") > most_bytes).withColumn("error", F.format_string(f"PackageError: %d bytes; {most_bytes} are allowed", "length"))
    sound = F.when(F.col("error").isNull(), F.col("content"))
    taken = small.select(F.sha2("content", 256).alias("doc_id"), F.col("path").alias("source"), sound.alias("content"), "error")
    return taken.unionByName(large.select(F.lit(None).cast("string").alias("doc_id"), F.col("path").alias("source"), F.lit(None).cast("binary").alias("content"), "error"))


def _fault(content: bytes) -> str | None:
    try:
        validated(content)
    except (PackageError, zipfile.BadZipFile, ExpatError, KeyError) as e:
        return f"PackageError: {e}"
    return None


def text_containers(packages: DataFrame) -> DataFrame:
    """Containers of packages (doc_id, content), in Arrow batches on the executors; packages without content have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                yield pd.DataFrame([{"doc_id": doc_id, **row} for row in containers_of(bytes(content))])

    return packages.where("content is not null").select("doc_id", "content").mapInPandas(run, CONTAINERS)


def rewritten_packages(packages: DataFrame, containers: DataFrame) -> DataFrame:
    """packages with the runs of the given containers put in; those of which none is given stay as they are."""
    own = containers.groupBy("doc_id").agg(F.collect_list(F.struct("container_id", "run_texts", "mirrors")).alias("__own"))

    @F.pandas_udf("binary")
    def put(contents: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([rewritten(bytes(c), {r["container_id"]: (list(r["run_texts"]), [list(m) for m in r["mirrors"]]) for r in o}) for c, o in zip(contents, rows, strict=True)])

    joined = packages.join(own, "doc_id", "left")
    return joined.withColumn("content", F.when(F.col("__own").isNotNull(), put("content", F.coalesce("__own", F.expr("array()").cast(own.schema["__own"].dataType)))).otherwise(F.col("content"))).drop("__own")


def write_atomically(content: bytes, source: str, output: str) -> None:
    """output holds content or is left as it was; it may not be the source."""
    if not output.lower().endswith(".docx") or os.path.isdir(output):
        raise PackageError("the output must be a .docx file")
    if os.path.realpath(source) == os.path.realpath(output) or (os.path.exists(output) and os.path.exists(source) and os.path.samefile(source, output)):
        raise PackageError("the output must not overwrite the input")
    folder = os.path.dirname(os.path.abspath(output))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder, prefix=".", suffix=".tmp.docx")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        with open(name, "rb") as f:
            validated(f.read())
        os.replace(name, output)
    finally:
        if os.path.exists(name):
            os.unlink(name)


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class DocxSource(DataSource):
    """spark.read.format("docx").load(path): the containers of one local file or of a local folder's files."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return CONTAINERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file:")

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            return [InputPartition(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.lower().endswith(".docx")]
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            content = f.read()
        doc_id = hashlib.sha256(content).hexdigest()
        for row in containers_of(content):
            yield (doc_id, *row.values())
