"""Sinks: text, JSON, DOCX, and publication by staging and swap."""

from __future__ import annotations

import io
import os
import shutil
import time
import uuid
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ["sort_name", "sort_title", "sort_year", "record_id"]


def write_text(rows: DataFrame, path: str, *, notice: str | None = None) -> None:
    """References in order, a blank line between them, parts in order of name; the notice is a folder beside it, named as it with .notice at the end.

    The order is by range, so no task holds the whole list.
    """
    listed = rows.filter("reference IS NOT NULL").orderBy(*ORDER).select(F.concat("reference", F.lit("\n")).alias("value"))
    listed.write.mode("overwrite").text(path)
    if notice:
        rows.sparkSession.createDataFrame([(notice + "\n",)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".notice")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def failures(rows: DataFrame) -> DataFrame:
    """Failed rows with what happened, paths and line ends out of the message."""
    said = F.regexp_replace(F.regexp_replace("message", r"[\r\n]+", " "), r"(?:[A-Za-z]:)?[/\\][^\s'\"]+", "<path>")
    return rows.filter("status = 'failed'").select("source_name", "phase", "exception_type", said.alias("message"))


def report_lines(assessed: DataFrame) -> DataFrame:
    """A block of text for each work that isn't ready."""
    listed = F.array_join(F.transform("issues", lambda i: F.concat(F.lit("- "), i)), "\n")
    return assessed.filter("readiness <> 'ready'").select("record_id", F.concat_ws("\n", F.col("source_name"), F.concat(F.lit("status: "), "readiness"), listed, F.col("reference")).alias("text"))


def docx_bytes(references: list[str], emphasis: list[list[str]] | None = None, *, heading: str = "REFERÊNCIAS", notice: str | None = None) -> bytes:
    """A minimal word-processing file: margins of 3 and 2 cm, 12 point type, left aligned, 12 points after each reference, emphasised values bold."""

    def runs(text: str, strong: list[str]) -> str:
        spans, taken = [], [False] * len(text)
        for value in strong:
            at = text.find(value)
            if value and at >= 0 and not any(taken[at : at + len(value)]):
                spans.append((at, at + len(value)))
                taken[at : at + len(value)] = [True] * len(value)
        out, i = [], 0
        for a, b in [*sorted(spans), (len(text), len(text))]:
            for part, bold in ((text[i:a], ""), (text[a:b], "<w:b/>")):
                if part:
                    out.append(f'<w:r><w:rPr><w:rFonts w:ascii="Times New Roman" w:hAnsi="Times New Roman"/>{bold}<w:sz w:val="24"/></w:rPr><w:t xml:space="preserve">{escape(part)}</w:t></w:r>')
            i = b
        return "".join(out)

    paragraph = lambda text, strong=(): f'<w:p><w:pPr><w:spacing w:after="240" w:line="240"/><w:jc w:val="left"/></w:pPr>{runs(text, list(strong))}</w:p>'
    body = paragraph(heading, [heading]) + (paragraph(notice) if notice else "") + "".join(paragraph(r, (emphasis or [[]] * len(references))[i]) for i, r in enumerate(references))
    document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:sectPr><w:pgMar w:top="1701" w:right="1134" w:bottom="1134" w:left="1701"/></w:sectPr></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", document)
    return out.getvalue()


class Publication:
    """Files appear together: they are written to a staging folder, which takes the target's place; the earlier one goes to a bounded history.

    An error leaves the target as it was and keeps the staging folder.  For local folders of the driver.
    """

    def __init__(self, target: str, *, history: int = 10):
        self.target, self.history = Path(target), history
        self.staging = self.target.with_name(f".{self.target.name}.staging-{uuid.uuid4().hex}")

    def __enter__(self) -> Path:
        self.staging.mkdir(parents=True)
        return self.staging

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            return
        past = self.target.with_name(f"{self.target.name}.history")
        kept = None
        if self.target.exists():
            past.mkdir(exist_ok=True)
            kept = past / f"{time.time_ns()}"
            os.replace(self.target, kept)
        try:
            os.replace(self.staging, self.target)
        except OSError:
            if kept:
                os.replace(kept, self.target)
            raise
        for old in sorted(past.iterdir())[: -self.history] if past.exists() else []:
            shutil.rmtree(old)
