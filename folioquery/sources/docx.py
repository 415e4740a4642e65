"""A Python data source for tables and text of DOCX files.

    spark.dataSource.register(DocxSource)
    spark.read.format("docx").option("mode", "cells").load(path)

``mode`` is cells (table_no, row_no, cells) or text (text). One file is one
partition. Paths are opened on the executors, so they must lie in storage that
all of them mount.
"""

from __future__ import annotations

import glob
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return "path string, text string" if self.options.get("mode") == "text" else "path string, table_no int, row_no int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return DocxReader(self.options)


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class DocxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options["path"].removeprefix("file://"), options.get("mode", "cells")

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: File):
        with zipfile.ZipFile(partition.path) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))

        def text(node) -> str:
            return "\n".join("".join(t.text or "" for t in p.iter(f"{W}t")) for p in node.iter(f"{W}p"))

        if self.mode == "text":
            yield partition.path, text(root)
            return
        for n, table in enumerate(root.iter(f"{W}tbl")):
            for m, row in enumerate(table.findall(f"{W}tr")):
                yield partition.path, n, m, [text(c).strip() for c in row.findall(f"{W}tc")]


def index_cells(cells: DataFrame) -> DataFrame:
    """Entries of index tables (date, provider, excerpt, pages), without headings, undated rows and rows without pages."""
    from folioquery.functions.dates import date_cell
    from folioquery.functions.pages import expand_pages
    from folioquery.functions.text import truncate_header

    c = [F.coalesce(F.get("cells", k), F.lit("")) for k in range(4)]
    rows = cells.filter(F.size("cells") >= 4).select("path", "table_no", "row_no", date_cell(c[0]).alias("date"), c[0].alias("date_str"), expand_pages(c[3]).alias("pages"), truncate_header(c[2]).alias("header"))
    return rows.filter(~F.col("date_str").rlike("(?i)date.*service")).filter((F.trim("date_str") != "") & (F.size("pages") > 0))
