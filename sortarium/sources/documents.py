"""Reading documents and predictions, extracting text from files, and writing results.

Files are listed and read by tasks; extractors and OCR backends are ports that executors call in
batches. JSON lines have explicit schemas; a bad line fails the read. Duplicate and blank lines: each
row stands, blank lines are none.
"""

from __future__ import annotations

import io
import json
import os
import re
import shutil
import subprocess
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice, repeat
from pathlib import Path
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortarium import schemas, session
from sortarium.functions import text as T
from sortarium.operators.gateway import GatewayError
from sortarium.sources import pdf as pdf_file


class UnsupportedDocument(ValueError):
    pass


class OCRUnavailable(RuntimeError):
    pass


# --- JSON lines -----------------------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_documents_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return schemas.document_defaults(read_jsonl(spark, path, schemas.DOCUMENT))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return schemas.prediction_defaults(read_jsonl(spark, path, schemas.PREDICTION))


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.QUEUE_ITEM + ", position int")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, wherever Spark finds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The label log; empty where there is none yet."""
    return read_jsonl(spark, path, schemas.LABEL) if exists(spark, path) else spark.createDataFrame([], schemas.LABEL)


def unfinished(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents that an earlier, interrupted run hasn't scored."""
    return docs.join(done.select("doc_id"), "doc_id", "left_anti")


# --- text of files --------------------------------------------------------------------------------


class OcrBackend(Protocol):
    name: str

    def transcribe(self, images: list[bytes]) -> str: ...


class Tesseract:
    """Local OCR by the tesseract program, found through TESSERACT_CMD, the PATH or its usual places."""

    name = "tesseract"
    PLACES = ("/usr/bin/tesseract", "/usr/local/bin/tesseract", "/opt/homebrew/bin/tesseract")

    def __init__(self, lang: str = "ara+eng"):
        self.lang = lang

    def program(self) -> str:
        for p in (os.environ.get("TESSERACT_CMD"), shutil.which("tesseract"), *self.PLACES):
            if p and os.path.exists(p):
                return p
        raise OCRUnavailable("tesseract isn't installed")

    def transcribe(self, images: list[bytes]) -> str:
        program = self.program()
        run = lambda i: subprocess.run([program, "stdin", "stdout", "-l", self.lang], input=i, capture_output=True, check=True).stdout.decode().strip()
        try:
            return "\n\n".join(run(i) for i in images)
        except (subprocess.CalledProcessError, OSError) as e:
            raise OCRUnavailable(f"tesseract failed: {e}") from e


class GatewayOcr:
    """OCR by a gateway's vision model: images as data URLs beside an instruction."""

    name = "gateway"
    INSTRUCTION = "انسخ النص الظاهر في الصور حرفياً كما هو، دون شرح أو تلخيص."

    def __init__(self, client=None, model: str = "", max_tokens: int = 4000):
        self.client, self.model, self.max_tokens = client, model, max_tokens

    def transcribe(self, images: list[bytes]) -> str:
        import base64

        if self.client is None:
            raise OCRUnavailable("no gateway client")
        parts = [{"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(i).decode()}} for i in images]
        try:
            return self.client.chat(model=self.model, messages=[{"role": "user", "content": [{"type": "text", "text": self.INSTRUCTION}, *parts]}], max_tokens=self.max_tokens)
        except (OSError, GatewayError) as e:
            raise OCRUnavailable(str(e)) from e


class HostedOcr:
    """OCR by a hosted vision service. The client is made when the first image comes, so that no key is needed before.

    The port has create(model=, max_tokens=, messages=) -> {"content": [{"type": "text", "text": ...}, ...]}. A refused
    key is OCRUnavailable; that the network fails is not, and comes through as it is.
    """

    name = "hosted"

    def __init__(self, make_client: Callable[[], object] | None = None, model: str = "", max_tokens: int = 4000):
        self.make_client, self.model, self.max_tokens, self._client = make_client, model, max_tokens, None

    def transcribe(self, images: list[bytes]) -> str:
        import base64

        if self._client is None:
            if self.make_client is None:
                raise OCRUnavailable("no client of a hosted service")
            self._client = self.make_client()
        parts = [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": base64.b64encode(i).decode()}} for i in images]
        try:
            reply = self._client.create(model=self.model, max_tokens=self.max_tokens, messages=[{"role": "user", "content": [*parts, {"type": "text", "text": GatewayOcr.INSTRUCTION}]}])
        except PermissionError as e:
            raise OCRUnavailable(str(e)) from e
        return "\n".join(b["text"] for b in reply["content"] if b.get("type") == "text").strip()


OCR: dict[str, Callable[..., OcrBackend]] = {"tesseract": Tesseract, "local": Tesseract, "gateway": GatewayOcr, "hosted": HostedOcr}


def ocr_backend(backend) -> OcrBackend | None:
    """A backend from its name; an instance or None stands for itself."""
    if backend is None or not isinstance(backend, str):
        return backend
    if backend not in OCR:
        raise OCRUnavailable(f"{backend!r} is none of {', '.join(sorted(OCR))}")
    return OCR[backend]()


#: What an extractor returns: text, source, pages.
Extraction = tuple[str, str, int]


def plain_text(content: bytes, ocr: OcrBackend | None = None) -> Extraction:
    return content.decode("utf-8"), "digital", 1


def docx(content: bytes, ocr: OcrBackend | None = None) -> Extraction:
    """Paragraphs of the body, then the rows of tables with tabs between cells; the format is a zip of XML."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{w}body")
    said = lambda node: "".join(t.text or "" if t.tag == f"{w}t" else "\t" if t.tag == f"{w}tab" else "\n" for t in node.iter() if t.tag in (f"{w}t", f"{w}tab", f"{w}br"))
    lines = [said(p) for p in body.findall(f"{w}p")]
    for row in body.iterfind(f"{w}tbl/{w}tr"):
        lines.append("\t".join("\n".join(said(p) for p in cell.findall(f"{w}p")) for cell in row.findall(f"{w}tc")))
    return "\n".join(lines), "digital", 1


def image(content: bytes, ocr: OcrBackend | None = None) -> Extraction:
    if ocr is None:
        raise OCRUnavailable("an image needs an OCR backend")
    return ocr.transcribe([content]), "ocr", 1


def usable(text: str, least: int = 40, threshold: float = 0.2) -> bool:
    """Whether a page's own text is real: long enough, and Arabic to the usual share."""
    letters = [c for c in text if c.isalpha()]
    return len(text.strip()) >= least and bool(letters) and sum("؀" <= c <= "ۿ" for c in letters) >= threshold * len(letters)


def pdf(content: bytes, ocr: OcrBackend | None = None, dpi: int = 200, is_usable: Callable[[str], bool] = usable) -> Extraction:
    """Text of a document from its pages' own text: the pages without a usable one go to OCR in one call, as their scans.

    Their text takes the place of the first of them; empty pages are left out.
    """
    try:
        pages = pdf_file.read_pages(content)
    except pdf_file.BadPdf as e:
        raise UnsupportedDocument(f"PDF: {e}") from e
    texts = [p.text if is_usable(p.text) else "" for p in pages]
    scanned = [k for k, p in enumerate(pages) if not is_usable(p.text)]
    if scanned:
        if ocr is None:
            raise OCRUnavailable(f"{len(scanned)} page(s) without a usable text layer need an OCR backend")
        texts[scanned[0]] = ocr.transcribe([pages[k].scan or pdf_file.blank(pages[k].size, dpi) for k in scanned])
    return "\n\n".join(t.strip() for t in texts if t.strip()), "ocr" if scanned else "digital", len(pages)


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text, usable, scan) of every page of the PDF files at path, from 0; a file that can't be read is one row with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,PDF}").load(path)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch.path, batch.content):
                try:
                    rows = [(where, k, p.text, usable(p.text), p.scan, None) for k, p in enumerate(pdf_file.read_pages(content))]
                except pdf_file.BadPdf as e:
                    rows = [(where, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "page", "text", "usable", "scan", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(pages, "path string, page int, text string, usable boolean, scan binary, error string")


def transcribed(pages: DataFrame, ocr, dpi: int = 200) -> DataFrame:
    """(path, text, source, page_count) of documents from their pages: OCR runs in tasks of its own, a call for each document.

    Only pages without a usable text travel with their scans; what OCR reads takes the place of the first of them.
    """
    backend = ocr_backend(ocr)

    def read(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("page")
        images = [scan if scan is not None else pdf_file.blank((595.0, 842.0), dpi) for scan in group.scan]
        if backend is None:
            raise OCRUnavailable(f"{len(images)} page(s) without a usable text layer need an OCR backend")
        return pd.DataFrame([(group.path.iloc[0], int(group.page.iloc[0]), backend.transcribe(images))], columns=["path", "page", "text"])

    good = pages.where("error IS NULL")
    seen = good.where("NOT usable").select("path", "page", "scan").groupBy("path").applyInPandas(read, "path string, page int, text string")
    parts = good.select("path", "page", F.when(F.col("usable"), F.trim("text")).alias("text"), (~F.col("usable")).alias("scanned"))
    parts = parts.unionByName(seen.select("path", "page", F.trim("text").alias("text"), F.lit(None).cast("boolean").alias("scanned")))
    said = F.filter(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"].isNotNull() & (p["text"] != ""))
    out = parts.groupBy("path").agg(F.array_join(F.transform(said, lambda p: p["text"]), "\n\n").alias("text"), F.bool_or("scanned").alias("ocr"), F.count("scanned").cast("int").alias("page_count"))
    return out.select("path", "text", F.when(F.col("ocr"), "ocr").otherwise("digital").alias("source"), "page_count")


EXTRACTORS: dict[str, Callable[..., Extraction]] = {".txt": plain_text, ".md": plain_text, ".docx": docx, ".pdf": pdf} | dict.fromkeys((".png", ".jpg", ".jpeg", ".tif", ".tiff"), image)


def register_extractor(suffix: str, extractor: Callable[..., Extraction]) -> None:
    """The latest extractor of a suffix counts."""
    EXTRACTORS[suffix.lower()] = extractor


#: Texts that a task hands on together, by number and by bytes of their files, and places that the driver deals out for listing.
_TOGETHER, _BYTES, _PLACES = 500, 8 << 20, 4000


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as the machines' own one if it lies on a file system that they mount, else None."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p)
    return where.toUri().getPath() if where.toUri().getScheme() == "file" else None


def _entries(folder: str) -> Iterator[tuple[str, bool]]:
    """(path, is it a folder) of what is in a folder; folders that Spark's readers pass over, such as those of unfinished jobs, are left out."""
    with os.scandir(folder) as found:
        for e in found:
            is_folder = e.is_dir()
            if not is_folder or not (e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name):
                yield e.path, is_folder


def _places(root: str) -> list[tuple[str, bool]]:
    """Files and folders that hold all that is below root. Folders are opened while that gives few; the others are left to tasks."""
    open_, out = deque([root]), []
    while open_ and len(out) + len(open_) < _PLACES:
        folder = open_.popleft()
        below = list(islice(_entries(folder), _PLACES))
        if len(below) == _PLACES:
            out.append((folder, True))
            continue
        open_ += [p for p, is_folder in below if is_folder]
        out += [(p, False) for p, is_folder in below if not is_folder]
    return out + [(p, True) for p in open_]


def _listed(spark: SparkSession, root: str, wanted: tuple[str, ...]) -> DataFrame:
    """(path) of the files at or below root with a wanted suffix; tasks list the folders."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stack, found = list(zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist())), []
            while stack:
                where, folder = stack.pop()
                for p, deeper in _entries(where) if folder else [(where, False)]:
                    if deeper:
                        stack.append((p, True))
                    elif p.endswith(wanted):
                        found.append(f"file:{p}")
                    if len(found) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])
                        found = []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])

    places = spark.createDataFrame(_places(root) if os.path.isdir(root) else [(root, False)], "path string, folder boolean")
    return places.repartition(spark.sparkContext.defaultParallelism).mapInArrow(files, "path string")


def read_files(spark: SparkSession, path: str, ocr=None, extractors: dict[str, Callable[..., Extraction]] | None = None) -> DataFrame:
    """Documents of a file, or of all supported files below a folder, ordered by path; doc_id is the file's name without suffix.

    Below a mounted folder tasks list and open the files, so that their names, which may be millions, don't pass through the
    driver; only the names are sorted. Elsewhere, and for patterns, they are Spark's binaryFile rows.
    """
    known = dict(extractors or EXTRACTORS)
    suffixes = [f for s in known for f in (s, s.upper())]
    backend = ocr_backend(ocr)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def handed_on() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["doc_id", "text", "source", "path", "page_count"])

        for batch in batches:
            rows, size = [], 0
            for where, content in zip(batch.path, batch.content if "content" in batch else repeat(None)):
                content = Path(where.removeprefix("file:")).read_bytes() if content is None else content
                stem, _, suffix = where.rsplit("/", 1)[-1].rpartition(".")
                text, source, pages = known[f".{suffix.lower()}"](content, backend)
                rows.append((stem, T.light_text(text), source, where, pages))
                size += len(content)
                if len(rows) == _TOGETHER or size > _BYTES:
                    yield handed_on()
                    rows, size = [], 0
            if rows:
                yield handed_on()

    columns = "doc_id string, text string, source string, path string, page_count int"
    root = mounted(spark, path)
    if root and os.path.exists(root):
        at_once = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        docs = _listed(spark, root, tuple(suffixes)).repartitionByRange(at_once, "path").sortWithinPartitions("path").mapInPandas(extract, columns)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(f"*{s}" for s in suffixes) + "}").load(path)
        docs = files.select("path", "content").mapInPandas(extract, columns).orderBy("path")
    return docs.withColumn("true_label", F.lit(None).cast("string"))


def read_documents(spark: SparkSession, path: str, ocr=None) -> DataFrame:
    """Documents from JSON lines, a folder or one file; what doesn't exist or has no extractor raises."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith(".jsonl"):
        return read_documents_jsonl(spark, path)
    suffix = re.search(r"(\.[A-Za-z0-9]+)$", path.rsplit("/", 1)[-1])
    if not is_folder(spark, path) and suffix and suffix[1].lower() not in EXTRACTORS:
        raise UnsupportedDocument(f"no extractor for {suffix[1]}")
    return read_files(spark, path, ocr)


def scanned(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if(F.col("source") == "ocr").alias("scanned"))


# --- sinks ----------------------------------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_labels(records: DataFrame, path: str) -> None:
    """Adds to the log; nothing in it is ever changed."""
    records.write.mode("append").json(path)


#: Characters that the name of a folder can't have, as in the folders of Spark's partitions.
_ESCAPED = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def write_text_files(docs: DataFrame, path: str) -> None:
    """One text file a document, <doc_id>.txt, in a folder for each label; each task writes its own rows.

    A label's folder has up to 256 folders, by the hash of the name, so that each can be listed by itself. Documents whose names
    are the same keep a file each: <doc_id>~<number>.txt. Where the path is not on a mounted file system, Spark's own writer
    makes a folder a document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.when(F.col("true_label") != "", F.col("true_label")), F.lit("unlabeled")).alias("label"), T.file_name(F.coalesce("doc_id", F.lit(""))).alias("name"), F.col("text").alias("value"))
    root = mounted(spark, path)
    if root is None:
        rows.write.mode("overwrite").partitionBy("label", "name").text(path)
        return
    session.removed(spark, path)
    same = rows.groupBy("label", "name").count().where("count > 1").select("label", "name", F.lit(True).alias("same"))
    n = same.count()
    rows = rows.join(F.broadcast(same) if n < 100_000 else same, ["label", "name"], "left") if n else rows.withColumn("same", F.lit(None).cast("boolean"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, written = TaskContext.get(), set(), 0
        for batch in batches:
            for label, name, text, same in zip(*(batch.column(c).to_pylist() for c in ("label", "name", "value", "same"))):
                folder = f"{root}/label={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', label)}/{zlib.crc32(name.encode()) & 255:02x}"
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                file = f"{folder}/{name}~{task.partitionId()}{written:09}.txt" if same else f"{folder}/{name}.txt"
                # attempts of one task may run side by side; each leaves whole files only, and the same ones
                part = f"{folder}/.{name}.{task.taskAttemptId()}"
                with open(part, "wb") as out:
                    out.write((text or "").encode())
                os.replace(part, file)
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    os.makedirs(root, exist_ok=True)


def save_as_files(docs: DataFrame, folder: str) -> int:
    """The same as plain <label>/<doc_id>.txt files on the local disk, row by row as they arrive at the driver."""
    n = 0
    for r in docs.select("doc_id", "text", "true_label").toLocalIterator():
        where = Path(folder) / (r.true_label or "unlabeled")
        where.mkdir(parents=True, exist_ok=True)
        (where / (re.sub(r"[^A-Za-z0-9_.-]", "_", r.doc_id) + ".txt")).write_text(r.text or "", encoding="utf-8")
        n += 1
    return n


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON file."""
    Path(path).write_text(json.dumps(json.loads(report.toJSON().first()), ensure_ascii=False, indent=2), encoding="utf-8")
