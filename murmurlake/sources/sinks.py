"""Exports.  Tables are written by Spark; files of one document are built from what an export filter leaves."""

from __future__ import annotations

import html
import io
import json
import zipfile
from collections.abc import Mapping, Sequence
from typing import Any
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.functions.stored import numbered
from murmurlake.functions.text import truncated
from murmurlake.functions.urls import maps_link
from murmurlake.operators.filters import filter_of, select_activities

PALETTE = ("#e6194b", "#3cb44b", "#4363d8", "#f58231", "#911eb4", "#46f0f0", "#f032e6", "#9a6324")


def _first(field: str) -> Column:
    return F.try_element_at("messages", F.lit(1))[field]


def csv_rows(activities: DataFrame) -> DataFrame:
    """The fifteen columns of the table export, numbered in input order."""
    return numbered(activities, [F.col("ord")], "_row").select(
        F.col("_row").alias("id"),
        "activity",
        "category",
        F.format_string("%.2f", "score").alias("confidence"),
        F.date_format(_first("timestamp"), "yyyy-MM-dd").alias("date"),
        F.date_format(_first("timestamp"), "HH:mm:ss").alias("time"),
        _first("sender").alias("sender"),
        F.substring(F.regexp_replace(_first("message"), r"[\r\n]+", " "), 1, 500).alias("message"),
        F.size("messages").alias("mentions"),
        F.concat_ws(", ", "place_name", "city", "country").alias("location"),
        "latitude",
        "longitude",
        maps_link(F.col("latitude"), F.col("longitude")).alias("maps_link"),
        "place_id",
        "place_lookup_source",
    )


def write_csv(activities: DataFrame, path: str) -> None:
    csv_rows(activities).coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(activities: DataFrame, path: str) -> None:
    activities.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The activities that ``write_json`` wrote, their messages' times as times again; messages are null where the file has none."""
    rows = spark.read.json(path)
    if "messages" not in rows.columns:
        return rows
    at = lambda m: F.try_to_timestamp(m["timestamp"])
    return rows.withColumn("messages", F.transform("messages", lambda m: m.withField("timestamp", at(m))))


def json_document(activities: DataFrame, input_file: str, message_count: int, version: str = "1") -> str:
    rows = [json.loads(r) for r in activities.orderBy("ord").toJSON().toLocalIterator()]
    meta = {"version": version, "inputFile": input_file, "messageCount": message_count, "activityCount": len(rows), "geocodedCount": sum("latitude" in r for r in rows)}
    return json.dumps({"metadata": meta, "activities": rows}, indent=2, ensure_ascii=False)


def map_rows(activities: DataFrame) -> DataFrame:
    """Located activities with short texts and a colour by sender, in order of first appearance."""
    located = activities.filter("latitude IS NOT NULL AND longitude IS NOT NULL").withColumn("sender", _first("sender"))
    ranks = numbered(located.groupBy("sender").agg(F.min("ord").alias("first_ord")), [F.col("first_ord"), F.col("sender")], "n", start=0)
    colour = F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.col("n") % len(PALETTE) + 1).cast("int"))
    told = located.join(ranks.select(F.col("sender").alias("_s"), colour.alias("colour")), F.col("sender").eqNullSafe(F.col("_s")), "left").drop("_s")
    return told.select("ord", "latitude", "longitude", "sender", "colour", truncated(F.col("activity"), 100).alias("activity"), truncated(_first("message"), 200).alias("message"))


def map_html(activities: DataFrame, title: str) -> str:
    """A page of its own with markers as data and a list; the list alone if nothing is located."""
    rows = [r.asDict() for r in map_rows(activities).orderBy("ord").toLocalIterator()]
    shown = rows or [r.asDict() for r in activities.select("ord", "activity").orderBy("ord").toLocalIterator()]
    items = "".join(f"<li>{html.escape(str(r['activity']))}</li>" for r in shown)
    data = json.dumps(rows, ensure_ascii=False).replace("</", "<\\/")
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><ol>{items}</ol><script>const points={data};</script>"


def xlsx_bytes(activities: DataFrame) -> bytes:
    """A workbook of one sheet with a frozen header."""
    rows = csv_rows(activities)
    table = [rows.columns, *[[x for x in r] for r in rows.orderBy("id").toLocalIterator()]]

    def cell(x: object) -> str:
        if isinstance(x, (int, float)):
            return f"<c><v>{x}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if x is None else str(x))}</t></is></c>'

    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in table)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Activities" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" state="frozen" topLeftCell="A2"/></sheetView></sheetViews><sheetData>{sheet}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def pdf_bytes(activities: DataFrame, title: str, lines_per_page: int = 50) -> bytes:
    """A plain document: title, counts, then activities by country, category and score."""
    rows = activities.select(F.coalesce("country", F.lit("General")).alias("c"), "category", "activity", "score", "ord").orderBy("c", "category", F.desc("score"), "ord")
    lines, last = [], None
    for r in rows.toLocalIterator():
        if (r["c"], r["category"]) != last:
            last = r["c"], r["category"]
            lines += ["", f"{r['c']} / {r['category']}"]
        lines.append(f"  {r['activity']} ({r['score']})")
    lines = [title, f"{sum(x.startswith('  ') for x in lines)} activities", *lines]
    blocks = [lines[i : i + lines_per_page] for i in range(0, len(lines), lines_per_page)]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for block in blocks:
        text = "".join(f"({''.join(chr(92) + c if c in '()' + chr(92) else c for c in line)}) ' " for line in block)
        body = f"BT /F1 10 Tf 14 TL 50 800 Td {text}ET"
        size = len(body.encode("cp1252", "replace"))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {len(objects) + 2} 0 R >>")
        objects.append(f"<< /Length {size} >>\nstream\n{body}\nendstream")
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(blocks)))
    objects[1] = f"<< /Type /Pages /Kids [{kids}] /Count {len(blocks)} >>"
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n{body}\nendobj\n".encode("cp1252", "replace")
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    end = f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF"
    return out + end.encode()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of one document, in whatever file system its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


KINDS = ("csv", "json", "excel", "map", "pdf")


def write_exports(activities: DataFrame, folder: str, kinds: Sequence[str], args: Mapping[str, Any], config: Mapping[str, Any] | None = None, title: str = "Activities") -> dict[str, str]:
    """Writes each kind with the filter that its own options make; the paths by kind.  Tables are folders of Spark, the rest single files."""
    wrong = [k for k in kinds if k not in KINDS]
    if wrong:
        raise ValueError(f"no such export: {', '.join(wrong)}")
    spark, made = activities.sparkSession, {}
    for kind in kinds:
        rows = select_activities(activities, filter_of(kind, args, config))
        made[kind] = path = f"{folder.rstrip('/')}/activities.{dict(excel='xlsx', map='html').get(kind, kind)}"
        if kind == "csv":
            write_csv(rows, path)
        elif kind == "json":
            write_json(rows, path)
        elif kind == "excel":
            write_bytes(spark, path, xlsx_bytes(rows))
        elif kind == "map":
            write_bytes(spark, path, map_html(rows, title).encode())
        else:
            write_bytes(spark, path, pdf_bytes(rows, title))
    return made
