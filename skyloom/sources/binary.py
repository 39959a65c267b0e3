"""Readers of structured files that Spark has no source for: HTML tables, VOTable, FITS, tar members.

Each file is read whole by one task (``binaryFile``) and emitted as rows in
batches; files are the unit of parallelism. The parsers are plain generators
over bytes, so they can be tested without Spark.
"""

from __future__ import annotations

import io
import re
import struct
import tarfile
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 5_000


class _Tables(HTMLParser):
    """Cells of all tables: (table id or index, row, column, text, href)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[str, int, int, str, str | None]] = []
        self.stack: list[dict] = []
        self.n = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.stack.append({"id": a.get("id") or str(self.n), "row": -1, "col": -1, "cell": None})
            self.n += 1
        elif self.stack:
            t = self.stack[-1]
            if tag == "tr":
                self._end(t)
                t["row"] += 1
                t["col"] = -1
            elif tag in ("td", "th"):
                self._end(t)
                t["col"] += 1
                t["cell"] = [[], None]
            elif tag == "a" and t["cell"]:
                t["cell"][1] = t["cell"][1] or a.get("href")

    def handle_data(self, data):
        if self.stack and self.stack[-1]["cell"]:
            self.stack[-1]["cell"][0].append(data)

    def handle_endtag(self, tag):
        if not self.stack:
            return
        if tag in ("td", "th", "tr"):
            self._end(self.stack[-1])
        elif tag == "table":
            self._end(self.stack[-1])
            self.stack.pop()

    def _end(self, t):
        if t["cell"]:
            text = " ".join("".join(t["cell"][0]).split())
            self.cells.append((t["id"], t["row"], t["col"], text, t["cell"][1]))
            t["cell"] = None


def html_cells(data: bytes) -> Iterator[tuple]:
    """(table, row, column, text, link) of every table cell."""
    parser = _Tables()
    parser.feed(data.decode("utf-8", "replace"))
    parser.close()
    yield from parser.cells


def votable_cells(data: bytes) -> Iterator[tuple]:
    """(table, row, column name, text) of the TABLEDATA tables of a VOTable; empty cells are null."""
    root = ElementTree.fromstring(data)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    for i, table in enumerate(e for e in root.iter() if local(e) == "TABLE"):
        name = table.get("name") or table.get("ID") or str(i)
        fields = [e.get("name") or e.get("ID") or str(k) for k, e in enumerate(x for x in table if local(x) == "FIELD")]
        for r, tr in enumerate(e for e in table.iter() if local(e) == "TR"):
            for field, td in zip(fields, tr):
                yield name, r, field, (td.text or "").strip() or None


_FITS = {"L": ("1s", 1), "B": ("B", 1), "I": (">h", 2), "J": (">i", 4), "K": (">q", 8), "E": (">f", 4), "D": (">d", 8), "A": ("s", 1)}


def _fits_header(data: bytes, at: int) -> tuple[dict[str, str], int]:
    cards: dict[str, str] = {}
    while at < len(data):
        block = data[at : at + 2880]
        at += 2880
        for i in range(0, 2880, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            if card[:8].strip() == "END":
                return cards, at
            if card[8:10] == "= ":
                value = card[10:]
                m = re.match(r"\s*'((?:[^']|'')*)'", value)
                cards[card[:8].strip()] = m.group(1).replace("''", "'").rstrip() if m else value.split("/")[0].strip()
    return cards, at


def fits_cells(data: bytes) -> Iterator[tuple]:
    """(hdu, row, column name, text) of FITS binary tables; nulls by TNULL, NaN and blank text; vectors as ``[a b]``."""
    at, hdu = 0, 0
    while at < len(data):
        cards, at = _fits_header(data, at)
        axes = [int(cards.get(f"NAXIS{i + 1}", 0)) for i in range(int(cards.get("NAXIS", 0)))]
        size = abs(int(cards.get("BITPIX", 8))) // 8 if axes else 0
        for n in axes:
            size *= n
        size += int(cards.get("PCOUNT", 0))
        if cards.get("XTENSION") == "BINTABLE":
            columns, offset = [], 0
            for k in range(1, int(cards["TFIELDS"]) + 1):
                m = re.match(r"(\d*)([LBIJKEDA])", cards[f"TFORM{k}"])
                repeat, kind = int(m.group(1) or 1), m.group(2)
                columns.append((cards.get(f"TTYPE{k}", str(k)), kind, repeat, offset, cards.get(f"TNULL{k}")))
                offset += repeat * _FITS[kind][1]
            for r in range(axes[1]):
                row = data[at + r * axes[0] : at + (r + 1) * axes[0]]
                for name, kind, repeat, start, null in columns:
                    form, width = _FITS[kind]
                    raw = row[start : start + repeat * width]
                    if kind == "A":
                        text = raw.split(b"\0")[0].decode("ascii", "replace").strip()
                        yield hdu, r, name, text or None
                        continue
                    values = [struct.unpack(form, raw[i * width : (i + 1) * width])[0] for i in range(repeat)]
                    texts = [None if v != v or (null is not None and str(v) == null) else ({b"T": "true", b"F": "false"}.get(v) if kind == "L" else repr(v)) for v in values]
                    yield hdu, r, name, texts[0] if repeat == 1 else "[" + " ".join(t if t is not None else "--" for t in texts) + "]"
        at += -(-size // 2880) * 2880
        hdu += 1


def tar_members(data: bytes) -> Iterator[tuple]:
    """(name, size, content) of the regular files of an archive; paths that leave it are an error."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        for m in tar:
            if m.name.startswith("/") or ".." in m.name.split("/"):
                raise ValueError(f"unsafe member {m.name}")
            if m.isfile():
                yield m.name, m.size, tar.extractfile(m).read()


FORMATS = {
    "html": (html_cells, "part string, row_number long, column_number long, text string, link string"),
    "votable": (votable_cells, "part string, row_number long, column_name string, text string"),
    "fits": (fits_cells, "part string, row_number long, column_name string, text string"),
    "tar": (tar_members, "member string, size long, content binary"),
}


def parse_cells(df: DataFrame, kind: str, content: str, keep: str) -> DataFrame:
    """Rows that a parser finds in a column of text or bytes, with the ``keep`` column; null content has none."""
    parser, schema = FORMATS[kind]
    names = [c.split()[0] for c in schema.split(", ")]
    rows = df.where(F.col(content).isNotNull()).select(F.col(keep).alias("source"), F.col(content).cast("binary").alias("c"))

    def run(batches):
        for pdf in batches:
            out = []
            for source, data in zip(pdf["source"], pdf["c"]):
                for row in parser(bytes(data)):
                    out.append((source, *row))
                    if len(out) >= BATCH:
                        yield _frame(out, names)
                        out = []
            if out:
                yield _frame(out, names)

    return rows.mapInPandas(run, f"source {df.schema[keep].dataType.simpleString()}, {schema}").withColumnRenamed("source", keep)


def _frame(out: list[tuple], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(out, columns=["source", *names])
    if "part" in names:
        pdf["part"] = pdf["part"].astype(str)
    return pdf


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All cells of the files under ``path`` (see ``FORMATS``), with ``source_member``."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_member"), "content")
    return parse_cells(files, kind, "content", "source_member")


def cells_to_table(cells: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """One all-text row per table row from (column_name, text) cells."""
    return cells.groupBy(*keep, "part", "row_number").agg(*[F.max(F.when(F.col("column_name") == c, F.col("text"))).alias(c) for c in columns])
