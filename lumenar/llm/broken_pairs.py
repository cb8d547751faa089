"""Broken pairs of prompt and response (problem 6).

Languages are compared by the posteriors of a letter-trigram naive Bayes over the prompt and over the response; breaking off is judged by how likely a text ends behind its last word, by
the token count where there is one, and by the prompt, whose words a broken last word begins. Refusals, placeholders and copied questions are told by their wording.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut_text import MARK, fit_tokenizer, has_word, token_count
from .language_labels import labelled_sample
from .letters import fit_naive_bayes, scores

DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")
#: Labelled texts the naive Bayes is fitted on.
SAMPLE = 5000
#: Log-odds by which a response must be likelier in another language than in the prompt's.
ODDS = 6.0

# Answers that are placeholders, and words that answer in any language.
PLACEHOLDERS = {"", "null", "none", "nan", "nil", "n/a", "na", "n a", "empty", "answer", "summary", "question", "response", "tbd", "todo", "undefined", "missing", "placeholder", "no response", "no answer", "blank"}
SOUND = {"yes", "no", "oui", "non", "ja", "nein", "sí", "si", "sim", "não", "nao", "unknown", "inconnu", "unbekannt", "desconocido", "desconhecido", "cannotanswer"}
# Inability or unwillingness of the speaker, and what is declined, by language.
REFUSALS = tuple(
    re.compile(p, re.IGNORECASE | re.DOTALL)
    for p in (
        r"\bI(?:['’]m| am)?\b[^\"“”]{0,25}\b(?:cannot|can['’]?t|can not|could not|couldn['’]t|unable|not able|won['’]t|will not|would rather not|rather not|must decline|have to decline|decline|refuse|not allowed|not permitted|not comfortable)\b[^\"“”]{0,30}\b(?:answer|assist|help|respon[ds]e?|comment|discuss|provide|comply|fulfil|share|say|that|this)\b",
        r"\bje\b[^\"“”«]{0,25}\b(?:ne (?:peux|suis|puis|souhaite|veux)|préf[èé]re ne|dois refuser|dois décliner|refuse|regrette)\b.{0,40}\b(?:répondre|aider|commenter|question|demande|sujet)\b",
        r"\b(?:ich (?:kann|darf|möchte|will|muss)|kann ich|darf ich|möchte ich|gebe ich|muss ich|bin ich nicht|ich bin nicht)\b.{0,60}\b(?:nicht|keine|ablehnen|leider)\b",
        r"\b(?:no (?:puedo|estoy autorizad[oa]|me es posible|me está permitido)|prefiero no|debo negarme|debo rechazar|lamento no|me niego)\b.{0,40}\b(?:responder|ayudar|atender|comentar|contestar|pregunta|petición|solicitud|tema|eso)\b",
        r"\b(?:não (?:posso|estou autorizad[oa]|me é possível|consigo)|prefiro não|devo recusar|tenho de recusar|recuso)\b.{0,40}\b(?:responder|ajudar|atender|comentar|pergunta|pedido|tema|isso)\b",
    )
)
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(MARK.replace("(?U)", "").replace(r"\x{FFFD}", "�"))
_INNER = re.compile(r"[.!?…][\"'”’»)\]]*\s+\S")
_TEMPLATE = re.compile(r"^\s*(?:Story|Context|Document)\s*:|\b(?:Question|Answer|Summary)\s*:", re.MULTILINE)


def question_of(prompt: str) -> str:
    body = re.sub(r"\s*\b(?:Answer|Summary)\s*:?\s*$", "", prompt)
    labelled = re.split(r"\bquestion\s*:", body, flags=re.IGNORECASE)[1:]
    if labelled and labelled[-1].strip() and not re.search(r"\banswer\s*:", labelled[-1], re.IGNORECASE):
        return labelled[-1].strip()
    line = body.rsplit("\n", 1)[1:]
    if line and line[0].strip():
        return line[0].strip()
    found = re.search(r"([^.?!\n]*\?)\W*$", body)
    return found[1].strip() if found else ""


def is_refusal(response: str) -> bool:
    return any(p.search(response) for p in REFUSALS)


def copies_question(response: str, question: str) -> bool:
    """The response is the question, once or several times over, up to small changes and a label."""
    q, r = _WORD.findall(question.lower()), _WORD.findall(response.lower())
    if r[:1] in (["question"], ["frage"], ["pregunta"], ["pergunta"]):
        r = r[1:]
    if len(q) < 3 or len(r) < max(2, 0.6 * len(q)):
        return False
    for times in (1, 2, 3):
        if 0.6 * len(q) <= len(r) / times <= 1.5 * len(q):
            a, b = " ".join(q * times), " ".join(r)
            m = difflib.SequenceMatcher(None, a, b, autojunk=False)
            if m.quick_ratio() >= 0.85 and m.ratio() >= 0.85:
                return True
    return False


def ending_likelihood(word: str, endings: dict[str, float]) -> float:
    """How likely a text ends behind a word without statistics of its own: by the longest of its endings of up to five letters that has some."""
    return next((endings[key] for n in range(5, 0, -1) if len(word) >= n and (key := "~" + word[-n:]) in endings), 1.0)


def breaks_off(response: str, prompt_words: set[str], missing: float | None, endings: dict[str, float], whole: set[str]) -> bool:
    """``whole``: texts that are often an answer by themselves. ``missing``: tokens beyond the text by the count (-1: no end mark), None if unknown. ``endings``: share of a word's uses that a text ends behind."""
    text = response.rstrip()
    if _MARK.search(text):
        return True
    if missing is not None and missing != 1:
        return missing < 0 or missing >= 2
    if not text[-1:].isalnum():
        return False
    used = _WORD.findall(text)
    if " ".join(used).lower() in whole:
        return False
    last = used[-1].lower()
    share = endings.get(last)
    likely = share if share is not None else ending_likelihood(last, endings)
    if share is not None and share < 0.01 or share is None and likely < 0.001 and last not in prompt_words:
        return True
    if len(used) >= 3 and last not in prompt_words and (share is None or share < 0.05) and any(w.startswith(last) for w in prompt_words):
        return True
    return missing is None and _INNER.search(text) is not None


def _judge(table, known: set[str], endings: dict[str, float], whole: set[str]):
    @F.pandas_udf("string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for prompts, responses, missing in batches:
            out: list[str | None] = [None] * len(prompts)
            at, asked, said = [], [], []
            for i, (p, r, m) in enumerate(zip(prompts, responses, missing, strict=True)):
                r, p = r or "", p or ""
                plain = " ".join(r.lower().strip(" \t\r\n:.[]<>()\"'​").split())
                if plain in PLACEHOLDERS or not _WORD.search(r):
                    out[i] = "empty"
                elif plain in SOUND:
                    continue
                elif is_refusal(r):
                    out[i] = "refusal"
                elif copies_question(r, question_of(p)):
                    out[i] = "copied_question"
                else:
                    if breaks_off(r, set(_WORD.findall(p.lower())), None if pd.isna(m) else m, endings, whole):
                        out[i] = "truncated"
                    own_words = [w for w in _WORD.findall(r.lower()) if w in known]
                    if own_words:  # names tell no language
                        at.append(i)
                        asked.append(_TEMPLATE.sub(" ", p))
                        said.append(" ".join(own_words))
            if at:
                own, other = scores(table, asked), scores(table, said)
                home = own.argmax(1)
                for n, i in enumerate(at):
                    gain = other[n].max() - other[n][home[n]]
                    letters = sum(c.isalpha() for c in said[n])
                    if gain > max(ODDS, 0.25 * letters) and own[n].any():
                        out[i] = "other_language"
            yield pd.Series(out, dtype=object)

    return judge


def ending_shares(responses: DataFrame, parts: int = 5000) -> tuple[dict[str, float], set[str]]:
    """How often a text ends behind a word and behind each of a word's endings of one to five letters (``~`` before it), and texts of up to four words that are often an answer by themselves.

    An end is a word before an end mark or the last one of a text that begins with a small letter (a short answer). Counted over all ``responses`` (``text``) and all their words; words, endings
    and answers that make up more than one in ``parts`` of the texts are kept, rarer words are judged by their endings, so the results have at most mean length x ``parts`` x 6 entries.
    """
    least = max(20, responses.count() // parts)
    used = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+[.?!]?)"), F.lit(1))
    short = F.col("text").rlike(r"^\s*\p{Ll}")
    placed = responses.select(F.posexplode(used).alias("i", "w"), F.size(used).alias("n"), short.alias("short"))
    ends = F.col("w").rlike(r"[.?!]$") | (F.col("short") & (F.col("i") == F.col("n") - 1))
    by_word = placed.groupBy(F.lower(F.regexp_replace("w", r"[.?!]$", "")).alias("word")).agg(F.count(F.lit(1)).alias("uses"), F.sum(ends.cast("long")).alias("ends"))
    endings = F.transform(F.sequence(F.lit(1), F.least(F.lit(5), F.length("word"))), lambda n: F.concat(F.lit("~"), F.expr("word").substr(-n, n)))
    each = by_word.select(F.explode(F.concat(F.array("word"), endings)).alias("word"), "uses", "ends").groupBy("word").agg(F.sum("uses").alias("uses"), F.sum("ends").alias("ends")).filter(F.col("uses") >= least)
    plain = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    answers = responses.filter(F.size(plain) <= 4).groupBy(F.lower(F.array_join(plain, " ")).alias("answer")).count().filter(F.col("count") >= least)
    return {r.word: r.ends / r.uses for r in each.collect()}, {r.answer for r in answers.collect()}


def frequent_vocabulary(texts: list[str], least: int = 5) -> set[str]:
    """Words of at least ``least`` of the sampled texts."""
    counts = Counter(w for t in texts for w in set(_WORD.findall(t.lower())))
    return {w for w, n in counts.items() if n >= least}


def broken_pairs(prompts: DataFrame, generations: DataFrame, documents: DataFrame) -> DataFrame:
    """(``record_table``, ``record_key``, ``defect``), one row per broken record.

    Rows with a null key are left out, repeated rows of a key count once, a null prompt leaves only the defects that the response shows by itself; empty tables give no rows. Whole texts are
    judged. ``documents`` (``doc_id``, ``text``, ``lang``) trains the naive Bayes on at most ``SAMPLE`` labelled texts.
    """
    p = prompts.select(F.lit("prompt_response").alias("record_table"), F.col("example_id").alias("record_key"), "prompt", F.col("response").alias("text"), F.lit(None).cast("int").alias("tokens"))
    g = generations.select(F.lit("generated_response").alias("record_table"), F.col("generation_id").alias("record_key"), "prompt", F.col("response").alias("text"), F.col("generated_token_count").cast("int").alias("tokens"))
    both = p.unionByName(g).filter(F.col("record_key").isNotNull())
    fit = fit_tokenizer(g)
    bare = F.regexp_replace("text", MARK, "")
    missing = F.when((F.col("tokens") > 0) & has_word(F.col("text")), F.col("tokens") - token_count(bare, fit[0]) - fit[1]) if fit else F.lit(None).cast("int")
    endings, whole = ending_shares(both.filter(has_word(F.col("text"))).select("text"))
    texts, labels = labelled_sample(documents, SAMPLE)
    if not texts:
        texts, labels = ["a"], labels.__class__((1,), dtype="int64") * 0
    table = fit_naive_bayes(texts, labels, 5)
    judged = both.select("record_table", "record_key", _judge(table, frequent_vocabulary(texts), endings, whole)("prompt", "text", missing.cast("double")).alias("defect"))
    return judged.filter("defect is not null").dropDuplicates(["record_table", "record_key"])
