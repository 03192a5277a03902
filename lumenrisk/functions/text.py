"""Text expressions: answers, ids, questions, label replies, prompts, token spans and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUESTION = r"(?i)Is there (?:a|an)\s+(.+?)\s+in the image"
#: A token of the default tokenizer: a run of word characters, or one other mark.
TOKEN = r"(?U)\w+|[^\w\s]"
MENTION = r"[a-z]+(?:'[a-z]+)?"
# The question templates by model, and the one of all others.
PROMPTS = {
    "llava_1_5_7b": "USER: <image>\n{question}\nAnswer the question using a single word or phrase.\nASSISTANT:",
    "llava_next_7b": "[INST] <image>\n{question}\nAnswer the question using a single word or phrase. [/INST]",
    "_default": "{question}\nAnswer the question using a single word or phrase.",
}


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def quoted(word: Column) -> Column:
    """A pattern that matches the word itself."""
    return F.regexp_replace(word, r"([^\p{L}\p{N}\s])", r"\\$1")


def yes_no(text: Column) -> Column:
    """yes, no or unknown: by the first word, else by the first of yes, no that the text contains."""
    low = F.lower(strip(text))
    word = F.regexp_replace(F.get(F.split(low, r"(?U)\s+"), F.lit(0)), "[^a-z]", "")
    return (
        F.when(word.isin("yes", "no"), word).when(low.contains("yes"), "yes").when(low.contains("no"), "no").otherwise("unknown")
    )


def pope_label(answer: Column, truth: Column, yes_only: bool = True) -> Column:
    """1 hallucinated, 0 true, -1 unlabelled."""
    no = F.lit(-1) if yes_only else (truth == "yes").cast("int")
    return F.when(answer == "yes", (truth == "no").cast("int")).when(answer == "no", no).otherwise(-1)


def image_id(name: Column) -> Column:
    """The first run of 12 digits, else the first run in the stem; names without digits get a stable hash."""
    long, any_ = F.regexp_extract(name, r"(\d{12})", 1), F.regexp_extract(F.regexp_replace(name, r"\.[^./]*$", ""), r"(\d+)", 1)
    return F.when(long != "", long.cast("long")).when(any_ != "", any_.try_cast("long")).otherwise(F.pmod(F.xxhash64(name), F.lit(1_000_000_000)))


def object_word(question: Column) -> Column:
    """The object of a yes/no question in lower case; null where the question has another form."""
    word = F.lower(F.trim(F.regexp_extract(question, QUESTION, 1)))
    return F.when(word != "", word)


def reply_labels(reply: Column) -> Column:
    """The JSON array of a reply, without code fences, in lower case; empty if it isn't one."""
    bare = F.trim(F.regexp_replace(reply, r"```(?:json)?", ""))
    return F.coalesce(F.transform(F.from_json(bare, "array<string>"), F.lower), F.array().cast("array<string>"))


def render_prompt(objects: Column, captions: Column) -> Column:
    return F.format_string("Objects: %s\nCaptions:\n%s", F.to_json(objects), F.array_join(F.transform(captions, lambda c: F.concat(F.lit("- "), strip(c))), "\n"))


def pope_prompt(model: Column, question: Column, prompts: dict[str, str] = PROMPTS) -> Column:
    known = F.create_map(*[F.lit(x) for kv in prompts.items() for x in kv])
    return F.replace(F.coalesce(F.try_element_at(known, model), F.lit(prompts["_default"])), F.lit("{question}"), question)


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def candidate_words(hallucinated: Column, truth: Column) -> Column:
    """(word, label) of the union; a word in both counts as hallucinated."""
    bad = F.transform(F.array_distinct(hallucinated), lambda w: F.struct(w.alias("word"), F.lit(1).alias("label")))
    good = F.transform(F.array_except(truth, hallucinated), lambda w: F.struct(w.alias("word"), F.lit(0).alias("label")))
    return F.concat(bad, good)


def token_spans(rows: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(id, word, label, start, first, n_tokens): rows hold text, n_ids (response length), word, label.

    The first whole-word match whose last token is inside the response counts. Token positions only grow along a
    text, so where the first match lies outside, all do. Words are matched without regard to case on the original
    text, so that offsets are its own.
    """
    pieces = F.split(F.col("text"), F.concat(F.lit(r"(?iU)\b"), quoted(F.col("word")), F.lit(r"\b")), 2)
    found = rows.where(F.length("word") > 0).select(id_col, "text", "word", "label", "n_ids", pieces.alias("pieces")).where(F.size("pieces") > 1)
    before = F.get("pieces", F.lit(0))
    surface = F.substring(F.col("text"), F.length(before) + 1, F.length("word"))
    found = found.select(id_col, "word", "label", "n_ids", F.length(before).alias("start"), n_tokens(before).alias("first"), n_tokens(surface).alias("n_tokens"))
    return found.where(F.col("first") + F.col("n_tokens") - 1 < F.col("n_ids")).drop("n_ids")


def mentions(docs: DataFrame, vocabulary: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """(id, mention_index, word, object): words of the vocabulary in order; greedy over pairs, then single words.

    vocabulary: a word, or two words with a space, to its canonical object.
    """
    known = F.create_map(*[F.lit(x) for kv in sorted(vocabulary.items()) for x in kv])
    words = F.regexp_extract_all(F.lower("text"), F.lit(MENTION), F.lit(0))
    at = lambda w, i: F.coalesce(F.get(w, i), F.lit(""))
    step = docs.select(id_col, words.alias("w"))
    if not any(" " in k for k in vocabulary):  # no pairs: nothing is consumed, each word stands for itself
        hits = F.filter(F.transform("w", lambda w: F.struct(w.alias("word"), F.try_element_at(known, w).alias("object"))), lambda s: s["object"].isNotNull())
        return step.select(id_col, F.posexplode(hits).alias("mention_index", "m")).select(id_col, "mention_index", "m.word", "m.object")
    state = F.struct(F.lit(0).alias("skip"), F.array().cast("array<struct<word:string,object:string>>").alias("out"))

    def take(s: Column, i: Column) -> Column:
        two = F.concat_ws(" ", at(F.col("w"), i), at(F.col("w"), i + 1))
        one = at(F.col("w"), i)
        hit2, hit1 = F.try_element_at(known, two), F.try_element_at(known, one)
        add = lambda word, obj: F.concat(s["out"], F.array(F.struct(word.alias("word"), obj.alias("object"))))
        return (
            F.when(s["skip"] > 0, F.struct((s["skip"] - 1).alias("skip"), s["out"].alias("out")))
            .when(hit2.isNotNull(), F.struct(F.lit(1).alias("skip"), add(two, hit2).alias("out")))
            .when(hit1.isNotNull(), F.struct(F.lit(0).alias("skip"), add(one, hit1).alias("out")))
            .otherwise(F.struct(F.lit(0).alias("skip"), s["out"].alias("out")))
        )

    steps = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    found = step.select(id_col, F.aggregate(steps, state, take)["out"].alias("m"))
    return found.select(id_col, F.posexplode("m").alias("mention_index", "m")).select(id_col, "mention_index", "m.word", "m.object")


def adapter_mentions(text: Column, spans: Column) -> Column:
    """(start, end, surface) in characters from (first, last) word offsets; spans out of bounds are left out."""
    words = F.split(text, " ")
    begin = lambda i: F.aggregate(F.slice(words, F.lit(1), i), F.lit(0), lambda s, w: s + F.length(w) + 1)
    ok = F.filter(spans, lambda s: (s["first"] >= 0) & (s["first"] <= s["last"]) & (s["last"] < F.size(words)))
    ends = lambda s: begin(s["last"]) + F.length(F.get(words, s["last"]))
    return F.transform(ok, lambda s: F.struct(begin(s["first"]).alias("start"), ends(s).alias("end"), F.substring(text, begin(s["first"]) + 1, ends(s) - begin(s["first"])).alias("surface")))


def object_position(text: Column, word: Column) -> Column:
    """Tokens before the word as a whole word, else as a substring; null where it doesn't occur."""
    whole = F.regexp_instr(text, F.concat(F.lit(r"(?iU)\b"), quoted(word), F.lit(r"\b")))
    plain = F.position(F.lower(word), F.lower(text))
    at = F.when(whole > 0, whole).otherwise(plain)
    return F.when(at > 0, n_tokens(F.substring(text, F.lit(1), at - 1)))
