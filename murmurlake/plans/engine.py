"""The analysis of chats end to end, as a graph of lazily built tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.functions.stored import numbered
from murmurlake.operators import candidates, classify, clustering, context, enrich
from murmurlake.operators.filters import ExportFilter, is_mappable, select_activities
from murmurlake.sources import chat
from murmurlake.sources.cache import Stages


class Engine:
    """Builds each stage once.  ``classifier`` turns (batch_id, prompt, expected_ids) into (batch_id, expected_ids, response)."""

    def __init__(
        self,
        spark: SparkSession,
        chats: DataFrame,
        classifier: Callable[[DataFrame], DataFrame],
        place_responses: DataFrame,
        instructions: str = "List the activities that these messages suggest, as JSON.",
        batch_size: int = 30,
        stages: Stages | None = None,
        fail_outside: bool = True,
    ):
        self.spark, self.chats, self.classifier, self.places = spark, chats, classifier, place_responses
        self.instructions, self.batch_size, self.stages = instructions, batch_size, stages
        self.fail_outside = fail_outside
        self.built: dict[str, DataFrame] = {}

    def get(self, stage: str) -> DataFrame:
        if stage not in self.built:
            if self.stages and self.stages.has(stage):
                self.built[stage] = self.stages.get(stage)
            else:
                made = getattr(self, f"_{stage}")()
                self.built[stage] = self.stages.put(stage, made) if self.stages else made
        return self.built[stage]

    def _messages(self) -> DataFrame:
        return chat.parse_chats(self.chats)

    def _candidates(self) -> DataFrame:
        return candidates.extract_candidates(self.get("messages"))

    def _contexts(self) -> DataFrame:
        found, messages = self.get("candidates"), self.get("messages")
        bounds = context.context_bounds(messages).select("chat_id", messages["id"].alias("message_id"), "first_id", "last_id")
        rows = context.with_context(found.join(bounds, ["chat_id", "message_id"]), messages)
        return context.fixed_batches(rows, self.batch_size, rows["message_id"])

    def _prompts(self) -> DataFrame:
        return classify.prompts(self.get("contexts"), self.instructions)

    def _activities(self) -> DataFrame:
        """Activities in the order of their messages.

        An offset means a message of the candidate's context.  One that points outside fails the stage, or means the candidate itself where
        ``fail_outside`` is off."""
        found = classify.to_activities(classify.parse_responses(self.classifier(self.get("prompts"))))
        keyed = found.withColumn("chat_id", F.regexp_replace("batch_id", r"#\d+$", ""))
        told = self.get("contexts").select("chat_id", "message_id", "sender", "content", "timestamp", "context_before", "context_after")
        own = F.struct(F.col("message_id").alias("id"), "sender", "content", "timestamp")
        meant = classify.at_offset(F.col("offset"), own, F.col("context_before"), F.col("context_after"))
        wrong = F.concat(F.lit("message "), F.col("message_id").cast("string"), F.lit(" of chat "), "chat_id", F.lit(" has no context at offset "), F.col("offset").cast("string"))
        rest = F.raise_error(wrong).cast(told.select(own.alias("m")).schema["m"].dataType) if self.fail_outside else own
        joined = keyed.join(told, ["chat_id", "message_id"]).withColumn("m", F.coalesce(meant, rest))
        entry = F.struct(F.col("m.id").alias("id"), F.col("m.timestamp").alias("timestamp"), F.col("m.sender").alias("sender"), F.col("m.content").alias("message"))
        order = [F.col(c) for c in ("batch_id", "chat_id", "message_id", "activity_id")]
        made = numbered(joined.withColumn("messages", F.array(entry)), order, "ord")
        return made.select(*[c for c in found.columns if c not in ("message_id", "offset", "batch_id")], "messages", "ord")

    def _grouped(self) -> DataFrame:
        rows = self.get("activities")
        return clustering.merge_groups(rows, clustering.leader_groups(rows))

    def _geocoded(self) -> DataFrame:
        rows = self.get("grouped")
        located = enrich.place_cascade(rows.filter(is_mappable()), self.places)
        return located.unionByName(rows.filter(~is_mappable()), allowMissingColumns=True)

    def export(self, f: ExportFilter) -> DataFrame:
        return select_activities(self.get("geocoded"), f)
