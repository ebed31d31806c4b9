"""Cards made by a model, and the provider that stands for it.

Prompts are built and replies parsed in columns; only the call itself is Python, a batch of prompts at a
time. A call that fails gives a null reply, so that a row never fails its partition.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.cards import prompt, reply_cards, summary
from lectern.functions.values import SUMMARIES_KEPT


#: Bytes of prompts that a Python worker gets at a time, unless the session says otherwise, and texts that it reads at a time.
_BATCH, _BATCH_BYTES, _TEXTS = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", 64


class Provider(Protocol):
    """A text model. It is made anew in each Python worker, so it need not be picklable."""

    name: str
    model: str

    def generate(self, prompt: str) -> tuple[str, int, int] | tuple[str, int, int, int]:
        """(reply, tokens in, tokens out), and tokens of thinking where the model tells them."""
        ...


class Offline:
    """A provider without a network: a card of each wanted type from the prompt's first words, the same each time."""

    name, model = "offline", "offline-1"

    def generate(self, prompt: str) -> tuple[str, int, int]:
        types = re.search(r"^Types: (.*)$", prompt, re.M)
        words = prompt.split()
        own = " ".join(words[:12])
        cards = [{"type": t, "content": {"title": own[:40], "body": own, "question": own + "?", "answer": own, "term": words[0], "excerpt": own, "itemA": words[0], "itemB": words[-1]}} for t in (types[1].split(", ") if types else [])]
        reply = json.dumps(cards, ensure_ascii=False)
        return reply, len(words), len(reply.split())


PROVIDERS: dict[str, Callable[[], Provider]] = {"offline": Offline}


def replies(provider: str = "offline") -> Callable[[Column], Column]:
    """A function on prompt columns: (reply, tokens_in, tokens_out, thinking, model, error, duration_ms).

    Where a call failed there is its error instead of reply and counts.
    """
    make = PROVIDERS[provider]
    kinds = {"reply": pa.string(), "tokens_in": pa.int64(), "tokens_out": pa.int64(), "thinking": pa.int64(), "model": pa.string(), "error": pa.string(), "duration_ms": pa.int64()}

    @F.arrow_udf("struct<reply:string,tokens_in:bigint,tokens_out:bigint,thinking:bigint,model:string,error:string,duration_ms:bigint>")
    def call(prompts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for batch in prompts:
            rows = []
            for first in range(0, len(batch), _TEXTS):  # a few texts at a time as Python's strings
                for text in batch.slice(first, _TEXTS).to_pylist():
                    began = time.monotonic()
                    try:
                        reply, tokens_in, tokens_out, *thinking = model.generate(text)
                        row = [reply, tokens_in, tokens_out, thinking[0] if thinking else None, model.model, None]
                    except Exception as error:  # whatever a remote model raises; the row stays, without a reply
                        row = [None, None, None, None, model.model, f"{type(error).__name__}: {error}"]
                    rows.append([*row, int(1000 * (time.monotonic() - began))])
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return call


def card_prompts(chunks: DataFrame) -> DataFrame:
    """``chunks`` (doc_id, pos, chunk_type, content, language, title, card_types, images, summaries) with ``prompt``; the
    chunk before is its context."""
    own = F.struct("content", "chunk_type", "language")
    before = F.lag(own).over(Window.partitionBy("doc_id").orderBy("pos"))
    return chunks.withColumn("_before", before).withColumn("prompt", prompt(own, F.col("_before"), F.col("title"), F.col("card_types"), F.transform("images", lambda x: x["alt"]), F.col("summaries"))).drop("_before")


def generated_cards(chunks: DataFrame, provider: str = "offline") -> DataFrame:
    """(doc_id, pos, nth, card_type, content): the cards that a model makes of each chunk."""
    session = chunks.sparkSession
    if session.conf.get(_BATCH, None) is None:
        session.conf.set(_BATCH, _BATCH_BYTES)
    asked = card_prompts(chunks).withColumn("answer", replies(provider)(F.col("prompt")))
    made = asked.withColumn("cards", reply_cards(F.coalesce("answer.reply", F.lit("")), F.col("card_types")))
    return made.select("doc_id", "pos", F.posexplode("cards").alias("nth", "card")).select("doc_id", "pos", "nth", "card.card_type", "card.content")


def rolling_summaries(cards: DataFrame, n: int = SUMMARIES_KEPT) -> DataFrame:
    """(doc_id, pos, summaries): the last ``n`` summaries of cards (doc_id, pos, nth, card_type, content) of earlier chunks.

    A frame by rows would hold all cards before; the last ``n`` chunks' cards are enough, as each has one.
    """
    per_chunk = cards.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("nth", summary(F.col("card_type"), F.col("content")).alias("s")))).alias("own"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-n, -1)
    all_ = F.flatten(F.collect_list(F.col("own.s")).over(before))
    return per_chunk.select("doc_id", "pos", F.slice(all_, F.greatest(F.size(all_) - n + 1, F.lit(1)), n).alias("summaries"))
