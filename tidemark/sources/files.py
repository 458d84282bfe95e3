"""Delimited transcripts, market files and result tables."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Collection, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_date
from ..schema import EVENT_STUDY, MONEY_MARKET, SHOCKS, TRANSCRIPT


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """statement_id, date, intro, qa from a |-separated file; the schema is given, nothing is inferred."""
    return spark.read.csv(path, sep="|", header=True, schema=TRANSCRIPT, multiLine=False).drop("url").withColumn("date", F.to_date("date"))


def write_transcripts(df: DataFrame, path: str) -> None:
    """Line breaks within a cell become spaces, so that the file can be read in splits; all else is kept."""
    cells = [F.translate(f.name, "\r\n", "  ").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in TRANSCRIPT]
    df.select(*cells).write.mode("overwrite").csv(path, sep="|", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _panel(df: DataFrame) -> DataFrame:
    values = [c for c in df.columns if c != "date"]
    return df.withColumn("date", clean_date("date")).dropna(how="all", subset=values)


def read_shocks(spark: SparkSession, path: str) -> DataFrame:
    """Market shocks from a CSV file with a header; columns are chosen by name, rows without any value dropped."""
    raw = spark.read.csv(path, header=True)
    return _panel(raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SHOCKS]))


def sheet_rows(data: bytes, sheet: str, wanted: Collection[str] | None = None) -> Iterator[dict[str, str]]:
    """A workbook sheet's rows by the header's names, from the file format's XML, one row at a time; ``wanted``: of these
    columns only. A sheet without rows gives none."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{main}t"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if e.tag == f"{main}si":
                    shared.append(text_of(e))
                    e.clear()
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        link = next(s.get(rel) for s in book.iter(f"{main}sheet") if s.get("name") == sheet)
        target = next(x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if x.get("Id") == link)
        names: dict[str, str] | None = None
        above: list = []
        for event, e in ElementTree.iterparse(z.open(f"xl/{target.lstrip('/').removeprefix('xl/')}"), ("start", "end")):
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if e.tag != f"{main}row":
                continue
            cells: dict[str, str] = {}
            for c in e.findall(f"{main}c"):
                at = re.sub(r"\d", "", c.get("r"))
                if names is not None and at not in names:
                    continue
                v, inline = c.find(f"{main}v"), c.find(f"{main}is")
                text = text_of(inline) if inline is not None else (v.text if v is not None else None)
                if text is not None:
                    cells[at] = shared[int(text)] if c.get("t") == "s" else text
            if names is None:
                names = {k: n for k, n in cells.items() if wanted is None or n in wanted}
            else:
                yield {names[k]: v for k, v in cells.items()}
            above[-1].clear()  # rows that have been read are let go


def read_sheet(spark: SparkSession, path: str, sheet: str, schema: T.StructType) -> DataFrame:
    """A workbook's sheet, the schema's columns only. Workbooks are read as files and parsed one a task; a date may be
    text or a serial day number."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                rows = sheet_rows(data, sheet, schema.names)
                while lot := list(itertools.islice(rows, 4096)):
                    yield pd.DataFrame([[r.get(n) for n in schema.names] for r in lot], columns=schema.names)

    text = T.StructType([T.StructField(n, T.StringType()) for n in schema.names])
    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, text)
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(F.try_to_number("date", F.lit("99999"))).cast("int")).cast("string")
    date = F.when(F.col("date").rlike(r"^\d{5}(\.\d+)?$"), serial).otherwise(F.col("date"))
    values = [F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema if f.name != "date"]
    return _panel(raw.select(date.alias("date"), *values))


def read_event_study(spark: SparkSession, path: str, sheet: str = "Press Conference Window") -> DataFrame:
    return read_sheet(spark, path, sheet, EVENT_STUDY)


def read_money_market(spark: SparkSession, path: str, sheet: str = "MM") -> DataFrame:
    return read_sheet(spark, path, sheet, MONEY_MARKET)


def workbook(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A workbook of text cells, for panels of a few hundred rows; empty cells are left out."""
    from xml.sax.saxutils import escape, quoteattr

    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = {"xl/workbook.xml": "sheet.main", **{f"xl/worksheets/sheet{i + 1}.xml": "worksheet" for i in range(len(sheets))}}
    types = "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in kinds.items())
    names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(sheets))
    links = "".join(f'<Relationship Id="r{i + 1}" Type="{office}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))

    def place(j: int) -> str:
        return ("" if j < 26 else place(j // 26 - 1)) + chr(65 + j % 26)

    def rows(table) -> str:
        cells = ((i, "".join(f'<c r="{place(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for j, v in enumerate(r) if v)) for i, r in enumerate(table, 1))
        return "".join(f'<row r="{i}">{c}</row>' for i, c in cells)

    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rels}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rels}">{links}</Relationships>')
        for i, t in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows(t)}</sheetData></worksheet>')
    return out.getvalue()


def write_workbook(spark: SparkSession, path: str, sheets: dict[str, list[list[str | None]]]) -> None:
    """:func:`workbook` as a file of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(workbook(sheets)))
    finally:
        stream.close()


def write_table(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header, in one file: for tables of a few thousand rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_correlations(spark: SparkSession, path: str) -> DataFrame:
    """A stored correlation table: no stars as '', one row per feature and era."""
    schema = "Era string, Feature string, Base string, Lag int, r double, p double, sig string, n int, target string"
    return spark.read.csv(path, header=True, schema=schema).fillna({"sig": ""}).dropDuplicates(["Feature", "Era"])
