"""A spreadsheet sink: tables as the sheets of one workbook file.

Tasks write their rows as parts of the sheets' XML beside the file; the commit
puts the parts together, in order, as an OOXML package.  An aborted write leaves
no file, and a task that ran twice counts once.  A workbook is one file, so its
parts are streamed through one process in the end; a sheet has SHEET_ROWS rows at
most, and more are an error, so this is bounded.

Defined cases: null cells are empty; numbers and booleans keep their kind, all else is text,
without the control characters that XML can't hold.  A table without rows is a
sheet with its header alone.
"""

from __future__ import annotations

import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Rows of a sheet, its header too; rows of a part, about.
SHEET_ROWS, PART_ROWS = 1 << 20, 50_000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATED = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KEPT = str.maketrans({c: None for c in range(32) if c not in (9, 10, 13)})
CELLS = "array<struct<text: string, number: double, truth: boolean>>"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _cell(cell: T.Row) -> str:
    if cell["truth"] is not None:
        return f'<c t="b"><v>{int(cell["truth"])}</v></c>'
    if cell["number"] is not None:
        return f"<c><v>{cell['number']:.17g}</v></c>"
    if cell["text"] is not None:
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(cell["text"].translate(_KEPT))}</t></is></c>'
    return "<c/>"


@dataclass
class Written(WriterCommitMessage):
    """Parts of sheets: (sheet, first row, rows, path)."""

    parts: list[tuple[int, int, int, str]]


class WorkbookWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.sheets = options["path"], options["sheets"].split("\x1f")
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[T.Row]) -> Written:
        system, folder = _place(self.folder)
        system.create_dir(folder)
        parts: list[tuple[int, int, int, str]] = []
        stream = None
        for row in iterator:
            if stream is None or row["sheet"] != parts[-1][0]:
                if stream is not None:
                    stream.close()
                name = f"{folder}/{uuid.uuid4().hex}"
                parts.append((row["sheet"], row["place"], 0, name))
                stream = system.open_output_stream(name)
            stream.write(f"<row>{''.join(map(_cell, row['cells']))}</row>".encode())
            parts[-1] = (*parts[-1][:2], parts[-1][2] + 1, parts[-1][3])
        if stream is not None:
            stream.close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _place(self.path)
        parts = sorted(part for message in messages if message for part in message.parts)
        for sheet, name in enumerate(self.sheets):
            if sum(rows for own, _, rows, _ in parts if own == sheet) > SHEET_ROWS:
                raise ValueError(f"the sheet {name} has more than {SHEET_ROWS} rows")
        with system.open_output_stream(f"{path}.new") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            self._package(book)
            for sheet in range(len(self.sheets)):
                with book.open(f"xl/worksheets/sheet{sheet + 1}.xml", "w") as target:
                    target.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    for own, _, _, name in parts:
                        if own == sheet:
                            with system.open_input_stream(name) as source:
                                shutil.copyfileobj(source, target)
                    target.write(b"</sheetData></worksheet>")
        system.move(f"{path}.new", path)
        self._clear()

    def _package(self, book: zipfile.ZipFile) -> None:
        number = range(1, len(self.sheets) + 1)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        overrides = f'<Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}worksheet+xml"/>' for i in number)
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{overrides}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATED}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_RELATED}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(number, self.sheets, strict=True)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_RELATED}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in number) + "</Relationships>")

    def _clear(self) -> None:
        system, folder = _place(self.folder)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options)


def write(spark: SparkSession, path: str, sheets: dict[str, tuple[DataFrame, list[str]]]) -> None:
    """Writes tables, each with the columns it is ordered by, as the sheets of a workbook.

    The ordering columns are not written.  An existing file is replaced.
    """
    rows, total = None, 0
    for sheet, (name, (table, order)) in enumerate(sheets.items()):
        held = table.limit(SHEET_ROWS).count()
        if held >= SHEET_ROWS:
            raise ValueError(f"the sheet {name} has more than {SHEET_ROWS} rows")
        total += held
        names = [c for c in table.columns if c not in order]
        kinds = {f.name: f.dataType for f in table.schema}
        none = {"text": F.lit(None).cast("string"), "number": F.lit(None).cast("double"), "truth": F.lit(None).cast("boolean")}

        def cell(name: str, kind: T.DataType, none=none):
            field = "truth" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, T.NumericType) else "text"
            return F.struct(*(F.col(f"`{name}`").cast("double" if k == "number" else "boolean" if k == "truth" else "string").alias(k) if k == field else v.alias(k) for k, v in none.items()))

        one = spark.range(1).select(F.lit(sheet).alias("sheet"), F.lit(0).alias("head"), F.lit(None).cast("string").alias("o"), F.array(*(F.struct(F.lit(n).alias("text"), none["number"].alias("number"), none["truth"].alias("truth")) for n in names)).cast(CELLS).alias("cells"))
        own = table.select(F.lit(sheet).alias("sheet"), F.lit(1).alias("head"), *(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)), F.array(*(cell(n, kinds[n]) for n in names)).cast(CELLS).alias("cells"))
        # the order of a sheet as a number, so that sheets with different keys meet
        placed = own.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY sheet ORDER BY {', '.join(f'o{i}' for i in range(len(order))) or 'cells'})")).select("sheet", "place", "cells")
        part = one.select("sheet", F.lit(0).alias("place"), "cells").unionByName(placed)
        rows = part if rows is None else rows.unionByName(part)
    spark.dataSource.register(Workbook)
    parts = 1 + total // PART_ROWS
    rows.repartitionByRange(parts, "sheet", "place").sortWithinPartitions("sheet", "place").write.format("workbook").mode("append").option("sheets", "\x1f".join(sheets)).save(path)
