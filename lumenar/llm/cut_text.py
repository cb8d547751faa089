"""Text cut off by field, token or transfer limits (problem 1).

A self-join by prefix finds values that are strict prefixes of longer copies elsewhere: values, whether their end is open or closed, are hashed over a fixed-length prefix and joined with the
same prefixes of all values. In data whose records each have an excerpt of their own most cut values have no longer copy, so three kinds of evidence stand beside the join: an end (or beginning) that no
whole sentence has, a mark of the transfer that cut it, and the token count, which tells whether the generator reached its end mark and whether text is missing after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix lengths that are hashed, each up to half as long again as the one before, up to 24,576 letters; a value is matched by the longest that it reaches and then compared in full.
#: Shorter values than the first are prefixes of others by chance (a name of a longer name), which tells nothing, and are not matched.
LADDER = [16, 24, *(n << k for k in range(10) for n in (32, 48))]
#: Letters per token piece that are tried for a generator's subword tokenizer.
PIECES = range(2, 9)

#: What a cut leaves behind: an ellipsis, a broken character, a hyphen within a word, a comma.
MARK = r"(?U)\s*(?:…|\.\.\.|\[(?:\.\.\.|…)\]|\x{FFFD}|(?<=\w)-|,)\s*$"
#: A prompt that ends with its closing label is whole, and one that a longer copy goes on from with such a label.
LABEL, LABEL_NEXT = r"(?U)\b(?i:Answer|Summary)\s*:\s*$", r"(?U)^\s*(?i:Answer|Summary)\s*:"
#: Letters of the longer copy that are compared with ``LABEL_NEXT``.
BEYOND = 12
CLOSED = r"(?U)(?:[.?!…。][\"'”’»)\]]*|\b(?i:Answer|Summary)\s*:)\s*$"


def has_word(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def cut_mark(text: Column) -> Column:
    return text.rlike(MARK)


def open_end(text: Column) -> Column:
    """Neither a sentence's end mark nor a prompt's closing label stands at the end."""
    return has_word(text) & (cut_mark(text) | ~text.rlike(CLOSED))


def open_start(text: Column) -> Column:
    """It begins within a sentence: with a small letter, though what follows isn't written in small letters throughout."""
    body = F.split(text, r"\n\s*Question\s*:")[0]
    return has_word(text) & text.rlike(r"^\s*[\"'“«(]*[\p{Ll}]") & body.rlike(r"\p{Lu}")


def token_count(text: Column, piece: int) -> Column:
    """Tokens of a tokenizer that cuts each run of letters or digits into pieces of ``piece`` and takes any other character that isn't blank as one."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.aggregate(runs, F.lit(0), lambda n, w: n + F.ceil(F.length(w) / piece).cast("int")) + F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]", ""))


def fit_tokenizer(values: DataFrame, least_share: float = 0.6) -> tuple[int, int] | None:
    """Piece length and usual surplus (the end mark) that explain most of the counts of ``values`` (``text``, ``tokens``); None if none explains ``least_share`` of them. Of pieces that
    explain about as many, the one with the smaller surplus is taken.

    All rows are counted; at most 101 surpluses for each of the pieces in ``PIECES`` reach the driver.
    """
    counted = values.filter(F.col("tokens").isNotNull() & has_word(F.col("text")))
    tried = counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("piece"), (F.col("tokens") - token_count(F.col("text"), k)).cast("int").alias("over")) for k in PIECES])).alias("t")).select("t.*")
    rows = tried.withColumn("over", F.greatest(F.lit(-50), F.least(F.lit(50), F.col("over")))).groupBy("piece", "over").count().collect()
    total = sum(r["count"] for r in rows if r.piece == PIECES[0])
    tops = [(r["count"], r.piece, r.over) for r in rows if abs(r.over) < 50]
    most = max((n for n, _, _ in tops), default=0)
    if not most or most < least_share * total:
        return None
    _, piece, over = min((t for t in tops if t[0] >= 0.97 * most), key=lambda t: (abs(t[2]), -t[0], t[1]))
    return piece, over


def longer_copies(values: DataFrame) -> DataFrame:
    """(``value_id``, ``within_word``, ``unlabelled``) of the open values that are strict prefixes of a longer value; ``within_word`` if some copy goes on with a letter, ``unlabelled`` if some
    copy goes on otherwise than with a closing label.

    ``values``: (``value_id`` bigint, ``text``, ``open``), one row per different text. An open value of at least 16 letters is hashed over its longest prefix in ``LADDER``; every value is
    hashed over all prefixes shorter than itself and brings along only the letters up to the next length and a few more, against which the rest of the open value is compared. So a row is sent once per
    prefix but hardly a letter twice, and a prefix that begins a third of all values meets only the few open values that end within the next 8 letters.
    """
    step = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in zip(LADDER, [*LADDER[1:], 1 << 30], strict=True)])
    parts = values.withColumn("step", F.explode(F.filter(step, lambda s: s.n <= F.length("text"))))
    n, m = F.col("step.n"), F.col("step.m")
    key = F.xxhash64(n, F.substring(F.col("text"), F.lit(1), n))
    rest, more = F.substring(F.col("text"), n + 1, m - n + 1), F.substring(F.col("text"), n + 1, m - n + BEYOND)
    copies = parts.select(key.alias("key"), more.alias("more")).distinct()
    last = parts.filter(F.col("open") & (F.length("text") < m)).select("value_id", key.alias("key"), rest.alias("rest"), F.substring("text", -1, 1).alias("end"))
    found = last.join(copies, "key").filter((F.length("more") > F.length("rest")) & F.col("more").startswith(F.col("rest")))
    after = F.substring(F.col("more"), F.length("rest") + 1, F.lit(1))
    beyond = F.substring(F.col("more"), F.length("rest") + 1, F.lit(BEYOND))
    within = F.col("end").rlike(r"[\p{L}\p{N}]") & after.rlike(r"[\p{L}\p{N}]")
    return found.groupBy("value_id").agg(F.max(within).alias("within_word"), F.max(~beyond.rlike(LABEL_NEXT)).alias("unlabelled"))


def cut_records(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per record with an open end or beginning, a longer copy or a count that doesn't fit: (``record_table``, ``record_key``, ``source``, ``longer_copy``, ``mark``, ``start``, ``tokens_missing``, ``evidence``, ``cut``).

    ``evidence`` names what decided of a cut record, the join first: ``longer_copy``, ``mark`` (of the transfer), ``count`` (of tokens), ``start`` or ``end``; null if it isn't cut. ``tokens_missing``: by how many tokens the count surpasses what the text accounts for (-1: no end mark; null where counts tell nothing). A prompt is cut if its end or beginning is open, or
    if it ends without a closing label and a longer copy goes on otherwise than with one (so a cut behind a sentence counts, and the history of a dialogue doesn't).
    A response is cut if it bears a mark, lacks the end mark or misses two or more tokens; one missing token is as a rule its full stop, and then it
    takes a longer copy that goes on within the last word. Where there are no usable counts any longer copy makes it cut. Short answers without a full stop are not cut for that.

    Null, blank or wordless texts and null keys give no row; repeated rows of a key count once; empty tables give no rows. The only broadcast or collected data are the sums of ``fit_tokenizer``.
    """
    p = prompts.select(F.lit("prompt_response").alias("record_table"), F.col("example_id").alias("record_key"), "source", F.col("prompt").alias("text"), F.lit(None).cast("int").alias("tokens"))
    r = responses.select(F.lit("generated_response").alias("record_table"), F.col("generation_id").alias("record_key"), "source", F.col("response").alias("text"), F.col("generated_token_count").cast("int").alias("tokens"))
    fit = fit_tokenizer(r)
    bare = F.regexp_replace("text", MARK, "")
    missing = F.when(F.col("tokens") > 0, F.col("tokens") - token_count(bare, fit[0]) - fit[1]) if fit else F.lit(None).cast("int")
    records = p.unionByName(r).filter(F.col("record_key").isNotNull() & has_word(F.col("text"))).withColumn("value_id", F.xxhash64("text"))
    is_prompt = F.col("record_table") == "prompt_response"
    marks = records.select("record_table", "record_key", "source", "value_id", cut_mark(F.col("text")).alias("mark"), open_end(F.col("text")).alias("end"), (is_prompt & open_start(F.col("text"))).alias("start"), F.col("text").rlike(LABEL).alias("labelled"), F.when(~is_prompt, missing).alias("tokens_missing"))
    values = records.groupBy("value_id").agg(F.any_value("text").alias("text")).withColumn("open", ~cut_mark(F.col("text")))
    copied = F.col("within_word").isNotNull()
    suspect = marks.join(longer_copies(values), "value_id", "left").filter(F.col("end") | F.col("start") | copied | F.coalesce(F.col("tokens_missing") != 0, F.lit(False)))
    lost = F.col("tokens_missing")
    counted = (lost < 0) | (lost >= 2) | ((lost == 1) & F.col("end") & F.coalesce("within_word", F.lit(False)))
    response = F.col("mark") | F.coalesce(counted, copied)
    prompt = F.col("end") | F.col("start") | (~F.col("labelled") & F.coalesce("unlabelled", F.lit(False)))
    cut = F.when(F.col("record_table") == "prompt_response", prompt).otherwise(response)
    by_copy = F.when(is_prompt, copied & (F.col("start") | F.col("end") | F.coalesce("unlabelled", F.lit(False)))).otherwise(copied)
    evidence = F.when(~cut, None).when(by_copy, "longer_copy").when(F.col("mark"), "mark").when(~is_prompt, "count").when(F.col("start"), "start").otherwise("end").alias("evidence")
    return suspect.select("record_table", "record_key", "source", copied.alias("longer_copy"), "mark", "start", "tokens_missing", evidence, cut.alias("cut")).dropDuplicates(["record_table", "record_key"])


def cut_rates(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """(``record_table``, ``source``, ``records``, ``cut``, ``by_copy``, ``by_mark``, ``by_count``, ``by_start``, ``by_end``, ``share``): how often each source's records are cut, and by what evidence; a null source is a row of its own."""
    kinds = {"by_copy": "longer_copy", "by_mark": "mark", "by_count": "count", "by_start": "start", "by_end": "end"}
    cut = cut_records(prompts, responses).filter("cut").select("record_table", "record_key", "evidence")
    keys = prompts.select(F.lit("prompt_response").alias("record_table"), F.col("example_id").alias("record_key"), "source").unionByName(responses.select(F.lit("generated_response").alias("record_table"), F.col("generation_id").alias("record_key"), "source"))
    once = keys.filter("record_key is not null").groupBy("record_table", "record_key").agg(F.min("source").alias("source"))
    counts = [F.count_if(F.coalesce(F.col("evidence") == kind, F.lit(False))).alias(name) for name, kind in kinds.items()]
    return once.join(cut, ["record_table", "record_key"], "left").groupBy("record_table", "source").agg(F.count(F.lit(1)).alias("records"), F.count("evidence").alias("cut"), *counts).withColumn("share", F.col("cut") / F.col("records"))
