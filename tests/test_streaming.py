"""Arriving chats: whole files with months that were there before, and lines one by one."""

import random

import pytest

from murmurlake.sources.chat import parse_chats
from murmurlake.streaming import chat_stream
from murmurlake.streaming.chat_stream import parse_stream, read_chat_files
from murmurlake.streaming.line_parser import LINES, parse_line_stream, read_line_files

CHAT = "1/2/24, 10:00 - Ann: we should go\n1/3/24, 10:00 - Bob: yes"


def _arrive(spark, tmp_path):
    messages, known, state = (str(tmp_path / n) for n in ("messages", "known", "state"))
    parse_stream(read_chat_files(spark, str(tmp_path / "in")), messages, known, state).awaitTermination(120)
    return spark.read.parquet(messages).count()


def test_known_months_are_not_written_again(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text(CHAT)
    assert _arrive(spark, tmp_path) == 2
    (inbox / "b.txt").write_text(CHAT)
    assert _arrive(spark, tmp_path) == 2
    (inbox / "c.txt").write_text(CHAT + "\n2/3/24, 10:00 - Bob: later")
    assert _arrive(spark, tmp_path) == 3


def test_equal_months_of_one_batch_are_written_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in "abc":
        (inbox / f"{name}.txt").write_text(CHAT)
    assert _arrive(spark, tmp_path) == 2
    assert spark.read.parquet(str(tmp_path / "messages")).select("chat_id").distinct().first()["chat_id"].endswith("a.txt")


@pytest.mark.parametrize("failing", ["messages", "known"])
def test_a_batch_that_broke_off_is_written_once(spark, tmp_path, monkeypatch, failing):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text(CHAT)
    assert _arrive(spark, tmp_path) == 2
    (inbox / "b.txt").write_text(CHAT + "\n3/3/24, 10:00 - Bob: later\n3/4/24, 10:00 - Bob: and on")
    write = chat_stream._write

    def breaks(df, folder, batch_id):
        write(df, folder, batch_id)
        if folder.endswith(failing):  # the table is written, the batch isn't committed
            raise OSError("lost")

    monkeypatch.setattr(chat_stream, "_write", breaks)
    with pytest.raises(Exception, match="lost"):
        _arrive(spark, tmp_path)
    monkeypatch.setattr(chat_stream, "_write", write)
    assert _arrive(spark, tmp_path) == 4
    assert spark.read.parquet(str(tmp_path / "known")).count() == 2


ANDROID = [
    "no header yet", "1/2/24, 10:00 - Ann: we should’ve gone https://a.example/x, and on", "second line", "", "1/2/24, 10:01 - Bob: image omitted",
    "1/2/24, 10:02 - Bob: This message was deleted", "13/45/24, 10:03 - Eve: no such day", "1/2/24, 10:04 - Ann: " + "long words " * 60, "tail   of it", "3/4/2024, 23:59 - Zoë: last: one",
]
IOS = ["‎[1/2/24, 10:00:05 AM] Ann: hello\r", "[1/2/24, 12:00:05 PM] Bob: ‎GIF omitted", "more", "[1/2/24, 12:00:06 AM] Bob left", "[1/2/24, 1:00:06 PM] Bob: Missed video call"] + [f"[1/3/24, 1:00:{i:02} PM] Bob: n{i}" for i in range(30)]
APPLE = ["Jan 2, 2024 10:00:00 AM (Read by you after 5 minutes)", "+123", "hello", "there", "", "Foo 2, 2024 10:00:00 AM", "Bob", "what", "Jan 3, 2024  1:00:00 PM", "Eve", "Jan 4, 2024 1:00:00 PM", " Me ", " yes ", "no"]
EMPTY = ["", "nothing here"]


def _columns(df):
    names = ["chat_id", "id", "timestamp", "sender", "content", "raw_line", "has_media", "media_type", "urls", "source", "chunk_index"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_in_any_batches_give_the_messages_of_the_files(spark, tmp_path, seed):
    rng = random.Random(seed)
    chats = {"android": ANDROID, "ios": IOS, "apple": APPLE, "empty": EMPTY, "mixed": IOS[:3] + ANDROID * 4}
    want = _columns(parse_chats(spark.createDataFrame([(k, "\n".join(v)) for k, v in chats.items()], "chat_id string, content string")))
    folder, out, state = (str(tmp_path / n) for n in ("lines", "out", "state"))
    lines = {k: [(k, i, t) for i, t in enumerate(v)] + [(k, len(v), None)] for k, v in chats.items()}
    sent = {k: 0 for k in chats}

    def run():  # a new query each time, from the checkpoint of the one before
        made = parse_line_stream(read_line_files(spark, folder))
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(180)

    for step in range(4):
        batch = []
        for k, rows in lines.items():
            upto = len(rows) if step == 3 else min(len(rows) - 1, sent[k] + rng.randint(0, len(rows)))
            again = max(0, sent[k] - 2)  # a few lines come twice
            batch += rows[again:upto]
            sent[k] = max(sent[k], upto)
        rng.shuffle(batch)
        spark.createDataFrame(batch, LINES).coalesce(1).write.mode("append").parquet(folder)
        run()
    assert _columns(spark.read.parquet(out)) == want


def test_the_source_may_be_given(spark, tmp_path):
    folder, out = str(tmp_path / "lines"), str(tmp_path / "out")
    rows = [("c", i, t) for i, t in enumerate(["x", *APPLE, None])]
    spark.createDataFrame(rows, LINES).write.parquet(folder)
    made = parse_line_stream(read_line_files(spark, folder), source="imessage", idle="1 hour")
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r["sender"] for r in spark.read.parquet(out).collect()} == {"+123", "Bob", "Me"} - ({"Bob"} if not any("Foo" in t for t in APPLE) else set())
