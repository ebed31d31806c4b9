"""Cards on columns: strategies, summaries, prompts, and what a model's reply holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import first_array, protected_escapes, shortened, strip, without_fences
from lectern.functions.values import DEFAULT_STRATEGY, LIKE_BOOK, STRATEGIES, TYPE_LABELS

_STRATEGY = "struct<card_types:array<string>,chunk_interval:int>"


def strategy(document_type: Column, reading_goal: Column) -> Column:
    """(card_types, chunk_interval) for a document; a missing goal counts as ``reflective``."""
    kind = F.when(document_type.isin(*LIKE_BOOK), "book").otherwise(F.coalesce(document_type, F.lit("book")))
    goal = F.coalesce(reading_goal, F.lit("reflective"))
    made = lambda s: F.struct(F.array(*map(F.lit, s[0])).alias("card_types"), F.lit(s[1]).alias("chunk_interval")).cast(_STRATEGY)
    found = F.coalesce(*(F.when((kind == k) & (goal == g), made(s)) for (k, g), s in STRATEGIES.items()), made(DEFAULT_STRATEGY))
    return found


def described(card_types: Column, interval: Column) -> Column:
    """A strategy in words."""
    names = F.transform(card_types, lambda t: F.coalesce(*(F.when(t == k, F.lit(v)) for k, v in TYPE_LABELS.items())))
    nth = F.when(interval == 1, "every passage").when(interval == 2, "every 2nd passage").when(interval == 3, "every 3rd passage").otherwise(F.concat(F.lit("every "), interval.cast("string"), F.lit("th passage")))
    return F.when(F.size(card_types) == 0, "No cards — reading mode only").otherwise(F.concat(F.array_join(names, " + "), F.lit(" cards, "), nth))


def summary(card_type: Column, content: Column) -> Column:
    """A card in a few words; ``content`` is its JSON."""
    field = lambda name: F.coalesce(F.get_json_object(content, f"$.{name}"), F.lit(""))
    titled = F.coalesce(F.get_json_object(content, "$.title"), field("body"))
    named = lambda prefix, text, most: F.concat(prefix, F.lit(": "), shortened(text, most))
    return (
        F.when(card_type.isin("discover", "raw_commentary", "connect"), named(card_type, titled, 80))
        .when(card_type.isin("flashcard", "quiz"), named(card_type, field("question"), 80))
        .when(card_type == "glossary", named(card_type, field("term"), 40))
        .when(card_type == "contrast", F.concat(F.lit("contrast: "), shortened(field("itemA"), 30), F.lit(" vs "), shortened(field("itemB"), 30)))
        .when(card_type == "passage", named(card_type, field("excerpt"), 80))
        .otherwise(F.concat(card_type, F.lit(": (card)")))
    )


def prompt(chunk: Column, before: Column, title: Column, card_types: Column, image_texts: Column, summaries: Column) -> Column:
    """What a model is asked for one chunk.

    ``chunk`` and ``before`` (may be null) have ``content``, ``chunk_type`` and ``language``.
    """
    context = (
        F.when(before.isNull(), "")
        .when(before["chunk_type"] == "image", F.concat(F.lit("[An image came before: "), F.coalesce(F.nullif(before["content"], F.lit("")), F.lit("no description")), F.lit("]\n\n")))
        .when(before["chunk_type"] == "code", F.concat(F.lit("[Code came before]\n```\n"), before["content"], F.lit("\n```\n\n")))
        .otherwise(F.concat(F.lit("[What came before, as context only]\n"), before["content"], F.lit("\n\n")))
    )
    name = F.coalesce(title, F.lit("Untitled"))
    is_code = chunk["chunk_type"] == "code"
    language = F.when(chunk["language"].eqNullSafe("en"), "").otherwise(F.coalesce(chunk["language"], F.lit("")))
    own = F.when(is_code, F.concat(F.lit('[Code from "'), name, F.lit('"]\n```'), language, F.lit("\n"), chunk["content"], F.lit("\n```"))).otherwise(F.concat(F.lit('[Text from "'), name, F.lit('"]\n'), chunk["content"]))
    lined = lambda items, shown: F.array_join(F.transform(items, shown), "\n")
    images = F.when(F.size(F.coalesce(image_texts, F.array())) > 0, F.concat(F.lit("Figures:\n"), lined(image_texts, lambda x, i: F.concat(F.lit("  ["), i.cast("string"), F.lit("] "), x)), F.lit("\n\n"))).otherwise("")
    done = F.when(F.size(F.coalesce(summaries, F.array())) > 0, F.concat(F.lit("Cards that exist already:\n"), lined(summaries, lambda x: F.concat(F.lit("  - "), x)), F.lit("\n\n"))).otherwise("")
    task = F.when(is_code, "Write study cards about this code: what it does, and the pattern behind it.").otherwise("Write study cards about this text; each must be understood without it.")
    return F.concat(context, own, F.lit("\n\n"), images, done, task, F.lit("\nTypes: "), F.array_join(card_types, ", "), F.lit('\nReply with a JSON array of {"type": ..., "content": {...}}, or [] if nothing here is worth a card.'))


def reply_cards(reply: Column, card_types: Column) -> Column:
    """The cards of a model's reply: an array of (card_type, content) with ``content`` as JSON.

    Formulas' backslashes are kept; an array within other text is found; entries of other types, or
    without an object as content, are left out. No array gives no cards.
    """
    text = protected_escapes(strip(F.regexp_replace(reply, r"```(?:json)?\s*", "")))
    whole, inner = F.try_parse_json(text), F.try_parse_json(F.coalesce(first_array(text), F.lit("null")))
    array = F.when(F.schema_of_variant(whole).startswith("ARRAY"), whole).otherwise(inner)
    items = F.coalesce(F.try_variant_get(array, "$", "array<variant>"), F.array())
    card = lambda v: F.struct(F.try_variant_get(v, "$.type", "string").alias("card_type"), F.to_json(F.try_variant_get(v, "$.content", "variant")).alias("content"))
    wanted = lambda c: c["card_type"].isNotNull() & F.array_contains(card_types, c["card_type"]) & c["content"].startswith("{")
    return F.filter(F.transform(items, card), lambda c: F.coalesce(wanted(c), F.lit(False)))


def reply_groups(reply: Column, first: Column, last: Column) -> Column:
    """Groups of segments first..last that a reply names, in order; each by itself where the reply is no such thing.

    Segments that the reply leaves out are added as groups of their own; one that is out of range spoils the reply.
    """
    own = F.transform(F.sequence(first, last), lambda i: F.array(i))
    text = strip(F.regexp_replace(reply, r"```(?:json)?\s*", ""))
    parsed = F.when(text.rlike(r"(?s)\A\[.*\]\z"), F.from_json(text, "array<array<int>>"))
    flat = F.flatten(parsed)
    fine = F.coalesce(parsed.isNotNull() & (F.size(parsed) > 0) & F.forall(parsed, lambda g: g.isNotNull() & (F.size(g) > 0)) & F.forall(flat, lambda i: i.isNotNull() & i.between(first, last)), F.lit(False))
    missing = F.array_except(F.sequence(first, last), flat)
    whole = F.concat(parsed, F.transform(missing, lambda i: F.array(i)))
    return F.array_sort(F.when(fine, whole).otherwise(own), lambda a, b: F.get(a, F.lit(0)) - F.get(b, F.lit(0)))


def reply_labels(reply: Column, n: Column, fallback: Column) -> Column:
    """The ``n`` labels front, main or back of a reply, or ``fallback`` where it has not exactly those."""
    parsed = F.from_json(without_fences(reply), "array<string>")
    fine = (F.size(parsed) == n) & F.forall(parsed, lambda x: F.coalesce(x.isin("front", "main", "back"), F.lit(False)))
    return F.when(F.coalesce(fine, F.lit(False)), parsed).otherwise(fallback)


def image_indices(content: Column) -> Column:
    """The figures that a card's JSON refers to; empty where there are none."""
    return F.coalesce(F.from_json(F.get_json_object(content, "$.images"), "array<int>"), F.array().cast("array<int>"))


def gathered(items: Column, indices: Column) -> Column:
    """The items at the indices that are in range."""
    return F.transform(F.filter(indices, lambda i: (i >= 0) & (i < F.size(items))), lambda i: F.get(items, i))


def shuffled(options: Column, *seed: Column) -> Column:
    """The indices of an array in the order in which its items are shown: by a digest of the seed and the index, so each run gives the same."""
    keyed = F.transform(options, lambda _, i: F.struct(F.md5(F.concat_ws(":", *seed, i.cast("string"))).alias("digest"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])
