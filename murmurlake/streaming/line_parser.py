"""Chats that arrive line by line: the messages of ``parse_chats``, whatever the batches in which the lines come.

A chat's state is its open message, the next id, the last line seen and, until the format is known, its first lines.  Lines meet the headers
before they are grouped, in the expressions that the batch parser uses; the stateful operator puts lines together and numbers pieces; types
and addresses follow as expressions again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from murmurlake.functions.text import pattern, plain_apostrophes, urls_in
from murmurlake.sources.chat import ANDROID_HEADER, IMESSAGE_HEADER, IOS_HEADER, SNIFFED_LINES, SYSTEM, header_time, media_type, split_text

LINES = "chat_id string, line_no long, text string"
_PIECES = "chat_id string, id long, at long, sender string, content string, whole string, raw_line string, source string, pos int, pieces int"


def _python(regex: str) -> re.Pattern:
    """A pattern of the batch parser with the same meaning here: ASCII classes, dots and ends that stop at every line terminator."""
    regex = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", regex)
    return re.compile(regex.replace(".*", r"[^\n\r\u0085\u2028\u2029]*").replace("$", r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"), re.ASCII | re.IGNORECASE)


_SYSTEM = _python(r"^\x{200E}?(?:" + "|".join(SYSTEM) + ")")
_WHATSAPP_START = _python(r"^\x{200E}?\[?\d{1,2}/\d{1,2}/\d{2,4},")
_IMESSAGE_START = _python(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}\s+\d{1,2}:\d{2}:\d{2} [AP]M")
_EDGES = re.compile(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z")


def source_of_start(text: str) -> str:
    """'imessage' or 'whatsapp', by how a chat begins."""
    start = text.lstrip(" ")[:200]
    return "imessage" if not _WHATSAPP_START.match(start) and re.match(_IMESSAGE_START.pattern, start, re.ASCII) else "whatsapp"


class OpenChat:
    """What is known of a chat between two batches; its fields are the state."""

    def __init__(self, source: str | None = None):
        self.given = source  #: the format that the caller knows, or None
        self.source: str | None = None
        self.form: str | None = None
        self.head: list[dict] = []  #: lines until the format is known
        self.message: dict | None = None
        self.next_id, self.last_line = 0, -1
        self.out: list[tuple] = []

    def line(self, row: dict[str, Any]) -> None:
        """The next line; one that was seen before is passed over."""
        if row["line_no"] <= self.last_line:
            return
        self.last_line = row["line_no"]
        if self.form is None:
            self.head.append(row)
            if len(self.head) == SNIFFED_LINES:
                self._settle()
        else:
            self._take(row)

    def close(self) -> None:
        """No line will follow the last one: the open message is complete."""
        if self.form is None and self.head:
            self._settle()
        self._finish()

    def _settle(self) -> None:
        self.source = self.given or source_of_start("\n".join(r["text"] for r in self.head))
        ios, android = (sum(r[kind] is not None for r in self.head) for kind in ("ios", "android"))
        self.form = "imessage" if self.source == "imessage" else "android" if android > ios else "ios"
        rows, self.head = self.head, []
        for row in rows:
            self._take(row)

    def _take(self, row: dict[str, Any]) -> None:
        found = row[self.form]
        if found is not None:
            self._finish()
            self.message = {"raw": row["text"], "at": found["at"], "sender": found.get("sender"), "lines": [] if self.form == "imessage" else [found["said"]]}
        elif self.message is not None:
            self.message["lines"].append(row["text"])

    def _finish(self) -> None:
        m, self.message = self.message, None
        if m is None:
            return
        if self.form == "imessage":
            filled = [x for x in (t.strip(" ") for t in m["lines"]) if x]
            if len(filled) < 2:
                return
            sender, content = filled[0], "\n".join(filled[1:])
        else:
            sender, content = m["sender"], "\n".join(m["lines"])
            if _SYSTEM.search(_EDGES.sub("", content)):
                return
        pieces = split_text(content)
        for pos, piece in enumerate(pieces):
            self.out.append((self.next_id, m["at"], sender, piece, content, m["raw"] if pos == 0 else "", self.source, pos, len(pieces)))
            self.next_id += 1

    def dumped(self) -> str:
        return json.dumps({k: v for k, v in vars(self).items() if k != "out"})

    @classmethod
    def loaded(cls, text: str) -> OpenChat:
        made = cls()
        vars(made).update(json.loads(text))
        return made


def _headers(lines: DataFrame) -> DataFrame:
    """Adds ios, android and imessage: what a line says as a header of each format (times in microseconds), as JSON; null if it is none."""
    text = plain_apostrophes(F.regexp_replace("text", r"\r$", ""))

    def told(regex: str, at: Column, *parts: Column) -> Column:
        return F.when(F.col("text").rlike(pattern(regex)), F.to_json(F.struct(F.unix_micros(at).alias("at"), *parts), {"ignoreNullFields": "false"}))

    def part(regex: str, i: int) -> Column:
        return F.regexp_extract("text", pattern(regex), i)

    apple = F.try_to_timestamp(F.concat_ws(" ", part(IMESSAGE_HEADER, 1), part(IMESSAGE_HEADER, 2)), F.lit("MMM d, yyyy h:mm:ss a"))
    columns = {"imessage": told(IMESSAGE_HEADER, apple)}
    for name, regex in (("ios", IOS_HEADER), ("android", ANDROID_HEADER)):
        columns[name] = told(regex, header_time(part(regex, 1), part(regex, 2)), F.trim(part(regex, 3)).alias("sender"), part(regex, 4).alias("said"))
    return lines.select("chat_id", "line_no", text.alias("text")).withColumns(columns)


def parse_line_stream(lines: DataFrame, source: str | None = None, idle: str | None = None) -> DataFrame:
    """A stream of messages, as ``parse_chats`` gives them, from a stream of (chat_id, line_no, text).

    Lines of a chat come in the order of ``line_no`` from batch to batch, in any order within one; lines that come again are passed over.  A row
    with a null text says that its chat is over, which writes the last message; so does, where ``idle`` is given ('10 minutes'), that time
    without a line.  ``source`` ('whatsapp', 'imessage') is told by the first lines where the caller doesn't know it.
    """
    kinds = ("ios", "android", "imessage")
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chat = OpenChat.loaded(state.get[0]) if state.exists else OpenChat(source)
        over = state.hasTimedOut
        if not over:
            rows = pd.concat(list(frames)).sort_values("line_no", kind="stable").to_dict("records")
            for row in rows:
                if row["text"] is None:
                    over = True
                    continue
                chat.line(row | {k: json.loads(row[k]) if isinstance(row[k], str) else None for k in kinds})
        if over:
            chat.close()
        out, chat.out = chat.out, []
        state.update((chat.dumped(),))
        if wait is not None and not over:
            state.setTimeoutDuration(wait)
        made = pd.DataFrame([(key[0], *r) for r in out], columns=["chat_id", "id", "at", "sender", "content", "whole", "raw_line", "source", "pos", "pieces"])
        made["at"] = made["at"].astype("Int64")
        made["pos"], made["pieces"] = made["pos"].astype("int32"), made["pieces"].astype("int32")
        yield made

    told = _headers(lines).groupBy("chat_id")
    pieces = told.applyInPandasWithState(step, _PIECES, "chat string", "append", "NoTimeout" if wait is None else "ProcessingTimeTimeout")
    kind = F.when(F.col("source") == "whatsapp", media_type(F.col("whole")))
    urls = urls_in(F.col("whole"))
    return pieces.select(
        "chat_id",
        "id",
        F.timestamp_micros("at").alias("timestamp"),
        "sender",
        "content",
        "raw_line",
        kind.isNotNull().alias("has_media"),
        kind.alias("media_type"),
        F.when((F.col("pos") == 0) & (F.size(urls) > 0), urls).alias("urls"),
        "source",
        F.when(F.col("pieces") > 1, F.col("pos")).alias("chunk_index"),
    )


def read_line_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (chat_id, line_no, text) from Parquet files of such rows that arrive in a folder."""
    return spark.readStream.schema(LINES).parquet(folder)
