"""Operators on training text against brute force, held-out accuracy or what must always hold, with the rows that real tables have: nulls, blanks, repeats, ties, clashing names, none at all."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenar.llm import broken_pairs, cut_text, grouped_split, languages, markov_clusters, mixing, packing, parity_sketch, queries, split_overlap
from lumenar.llm.common import cut_lineage
from lumenar.llm.components import connected_components
from lumenar.llm.language_labels import read_label
from lumenar.llm.token_sizes import with_tokens

WORDS = re.compile(r"[^\W_]+")
SYLLABLES = ["bal", "cor", "dra", "fen", "gri", "hol", "jas", "kel", "lan", "mir"]
NAMES = ["".join(SYLLABLES[n // 10**k % 10] for k in range(4)).title() for n in range(0, 10000, 3)]
PEOPLE = ["the miller", "the tailor", "the lock keeper", "the night nurse", "the ferry pilot"]
DEEDS = ["painted", "sold", "returned", "measured", "found", "hid"]
THINGS = ["the copper bell", "a heavy ladder", "an old diary", "the north gate", "a clay jug"]


def sentence(r):
    return f"{r.choice(PEOPLE).capitalize()} {r.choice(NAMES)} {r.choice(DEEDS)} {r.choice(THINGS)} near the quay of {r.choice(NAMES)}."


def story(r, n=5):
    return " ".join(sentence(r) for _ in range(n))


def jaccard(a, b):
    x, y = set(WORDS.findall(a.lower())), set(WORDS.findall(b.lower()))
    return len(x & y) / len(x | y) if x | y else 0.0


def rows(df):
    return {tuple(r) for r in df.collect()}


PROMPTS = "example_id string, prompt string, response string, split string, group_id string, source string, value_id string, key string, id string, side int, tokens int, cut string"
GENERATIONS = "generation_id string, prompt string, response string, generated_token_count int, source string, value_id int, text string"


def prompts(spark, data):
    full = [{"example_id": None, "prompt": None, "response": None, "split": None, "group_id": None, "source": None, "value_id": "clash", "key": "clash", "id": "clash", "side": 9, "tokens": 9, "cut": "clash"} | d for d in data]
    return spark.createDataFrame(full, PROMPTS) if full else spark.createDataFrame([], PROMPTS)


def test_components_against_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(7, 7), (5, None)] + [(1000, n) for n in range(1001, 1200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = dict(rows(connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert found == {n: find(n) for n in list(root)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_grouped_split_keeps_groups_and_proportions(spark):
    data = [{"example_id": f"coqa-{n}", "group_id": f"coqa-story-{n // 4:05d}", "split": "train"} for n in range(2000)]
    data += [{"example_id": "coqa-1", "group_id": "coqa-story-00000", "split": "train"}]  # a repeated row
    data += [{"example_id": "coqa-a", "group_id": " CoQA_Story_00000", "split": " Dev "}, {"example_id": "coqa-b", "group_id": None, "split": None}, {"example_id": None, "group_id": "coqa-story-00001", "split": "all"}]
    data += [{"example_id": f"coqa-big{n}", "group_id": "coqa-story-99999", "split": "test"} for n in range(1000)]
    df = prompts(spark, data)
    audit = {r.group_id: r for r in grouped_split.split_audit(df).collect()}
    assert [g for g, r in audit.items() if r.splits > 1] == ["coqa-story-00000"]
    assert audit["coqa-story-00001"].splits == 1 and len(audit) == 501
    config = spark.createDataFrame([("coqa", 0.8, 0.1, 0.1, 7, "group")], "name string, train_ratio double, validation_ratio double, test_ratio double, split_seed int, split_unit string")
    out = {r.example_id: r for r in grouped_split.assign_splits(df, config).collect()}
    assert len(out) == 3002
    assert all(len({out[f"coqa-{n}"].assigned_split for n in range(4 * g, 4 * g + 4)}) == 1 for g in range(500))
    assert out["coqa-a"].assigned_split == out["coqa-0"].assigned_split and {out[f"coqa-big{n}"].assigned_split for n in range(1000)} == {"train"}
    share = sum(r.assigned_split == "test" for r in out.values()) / len(out)
    assert 0.07 < share < 0.13
    assert grouped_split.split_audit(prompts(spark, [])).count() == 0 and grouped_split.assign_splits(prompts(spark, []), config).count() == 0


@pytest.mark.parametrize("names", [3334, 10])
def test_near_duplicates_against_brute_force(spark, monkeypatch, names):
    """With as many names as real texts have, and with so few that no word is rare."""
    monkeypatch.setitem(globals(), "NAMES", NAMES[:names])
    r = random.Random(1)
    texts = [story(r) for _ in range(250)]
    for n in range(0, 150, 2):
        w = texts[n].split()
        for _ in range(r.randrange(1, 8)):
            w[r.randrange(len(w))] = r.choice(["really", "teh", "also", "updated"])
        texts.append(" ".join(w[20:] + w[:20]))
    data = [(f"x{n}", t) for n, t in enumerate(texts)] + [("x0", texts[0]), ("same", texts[1]), ("empty", ""), ("null", None), (None, texts[2]), ("long", story(r, 3000)), ("short1", "A clay jug."), ("short2", "a clay  jug")]
    df = spark.createDataFrame([(*d, "clash", 1) for d in data], "id string, text string, key string, tokens int")
    member, links = parity_sketch.near_duplicates(df, "id", F.col("text"), 0.7)
    by = {k: t or "" for k, t in data if k}
    want = {tuple(sorted(p)) for p in combinations(by, 2) if jaccard(by[p[0]], by[p[1]]) >= 0.7}
    assert rows(parity_sketch.key_pairs(member.filter("key not in ('empty', 'null')"), links)) == want
    groups = {x.id: x for x in parity_sketch.duplicate_groups(member, links).collect()}
    assert len(groups) == len(by) and groups["x1"].group_id == groups["same"].group_id and groups["x1"].class_id == groups["same"].class_id
    assert names < 100 or (groups["x249"].links == 0 and groups["x249"].group_size == 1)
    member, links = parity_sketch.near_duplicates(df.limit(0), "id", F.col("text"))
    assert parity_sketch.key_pairs(member, links).count() == 0 and parity_sketch.duplicate_groups(member, links).count() == 0


def test_links_in_a_hot_group(spark):
    """Copies whose shared words are all frequent, each edited with words of its own."""
    r = random.Random(21)
    body = story(r, 12).split()
    texts = [" ".join(body + [f"own{n}x{k}" for k in range(4)]) for n in range(12)] + [story(r) for _ in range(60)]
    df = spark.createDataFrame([(f"x{n}", t) for n, t in enumerate(texts)], "id string, text string")
    want = {tuple(sorted((f"x{a}", f"x{b}"))) for a, b in combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.7}
    assert len(want) >= 66
    assert rows(parity_sketch.key_pairs(*parity_sketch.near_duplicates(df, "id", F.col("text")))) == want


def test_links_of_texts_with_three_rare_words(spark):
    """Copies that keep one of three rare words, and copies with more than ten rare words changed."""
    r = random.Random(22)
    common, texts = [f"common{n}" for n in range(90)], []
    for n in range(16):
        some = r.sample(common, 40)
        texts += [" ".join(some + [f"one{n}", f"two{n}", f"three{n}"]), " ".join(some + [f"one{n}", f"four{n}", f"five{n}"])]
    own = [f"long{n}" for n in range(100)]
    texts += [" ".join(own), " ".join(own[:83] + [f"other{n}" for n in range(17)])]
    df = spark.createDataFrame([(f"x{n}", t) for n, t in enumerate(texts)], "id string, text string")
    want = {tuple(sorted((f"x{a}", f"x{b}"))) for a, b in combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.7}
    assert len(want) == 17
    assert rows(parity_sketch.key_pairs(*parity_sketch.near_duplicates(df, "id", F.col("text")))) == want


def test_a_sketch_bounds_the_difference():
    r = random.Random(2)
    sets = [{hash((n % 7, k)) % (1 << 40) * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(r.randrange(3, 90))} for n in range(40)]
    starts = np.cumsum([0, *map(len, sets[:-1])])
    bits = parity_sketch.sketches(np.array([x for s in sets for x in s], np.uint64), starts)
    for a, b in combinations(range(len(sets)), 2):
        assert sum((int(x) ^ int(y)).bit_count() for x, y in zip(bits[a], bits[b], strict=True)) <= len(sets[a] ^ sets[b])


@pytest.mark.parametrize("rare", [0, 2, 20])
def test_links_however_few_words_are_rare(spark, rare):
    """Texts of few different words, edited in any number of places; every word, some or none count as frequent."""
    r = random.Random(31)
    vocabulary = [f"w{n}" for n in range(130)]
    sets = []
    for n in range(60):
        base = r.sample(vocabulary, r.choice([1, 2, 3, 5, 9, 14, 30, 60, 110]))
        sets.append(base)
        for _ in range(4):
            edited = [w for w in base if r.random() > 0.12] + [r.choice(vocabulary) if r.random() < 0.5 else f"own{n}{r.random()}" for _ in range(len(base) // 7 + (r.random() < 0.2))]
            sets.append(list(dict.fromkeys(edited)) or base)
    df = spark.createDataFrame([(n, s, n % 2) for n, s in enumerate(sets)], "id long, words array<string>, side int").withColumn("tokens", F.transform("words", lambda w: F.xxhash64(w)))
    for threshold in (0.5, 0.7, 0.8):
        want = {(a, b) for a, b in combinations(range(len(sets)), 2) if len(set(sets[a]) & set(sets[b])) >= threshold * len(set(sets[a]) | set(sets[b]))}
        assert len(want) > 60
        assert want <= rows(parity_sketch.candidate_pairs(df, threshold, rare=rare))
        split = {tuple(sorted(p, key=lambda n: n % 2)) for p in want if sum(p) % 2}
        assert split <= rows(parity_sketch.candidate_pairs(df, threshold, "side", rare=rare))


def test_texts_of_one_side_are_not_compared(spark):
    """Many like texts of side 0 and a few of side 1, all words frequent: what leaves a task follows the keys of side 1, and no row meets another of its side or its role."""
    r = random.Random(5)
    vocabulary = [f"w{n}" for n in range(300)]
    near = r.sample(vocabulary, 30)
    sets = [r.sample(vocabulary, 30) for _ in range(300)] + [near, [*near[:29], "w0x"], r.sample(vocabulary, 30)]
    df = spark.createDataFrame([(n, s, int(n > 300)) for n, s in enumerate(sets)], "id long, words array<string>, side int").withColumn("tokens", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    assert (300, 301) in rows(parity_sketch.candidate_pairs(df, 0.7, "side", rare=1))
    corpus = parity_sketch.frequent_words(df, 0.7, 1)
    met, bits = parity_sketch._key_map(df.filter("side = 1"), corpus)
    every, left = (parity_sketch._rows_across(df.filter("side = 0"), corpus, 0, *x) for x in ((), (met, bits)))
    other = parity_sketch._rows_across(df.filter("side = 1"), corpus, 1)
    assert left.count() < every.count() / 2 and left.join(other, "key").count() == every.join(other, "key").count() > 0


def test_split_overlap_against_brute_force(spark):
    r = random.Random(3)
    data, asked = [], {}
    for n in range(120):
        passage, question = story(r, 4), f"Who {r.choice(DEEDS)} {r.choice(THINGS)}?"
        data.append((f"t{n}", f"Story: {passage}\nQuestion: {question}\nAnswer:", " Train"))
        asked[f"t{n}"] = question
        if n % 3 == 0:
            edited = passage.replace(" near ", " really near ", 1) if n % 2 else passage.upper()
            data.append((f"e{n}", f"Context:  {edited}\nQuestion: {question[:-1]} ?\nAnswer:", "dev"))
            asked[f"e{n}"] = question
        elif n % 3 == 1:
            data.append((f"e{n}", f"Story: {passage}\nQuestion: Where was the court clerk at that moment?\nAnswer:", "TEST"))
            asked[f"e{n}"] = "other"
    want = {tuple(sorted((a, b))) for a, pa, _ in data for b, pb, _ in data if a[0] == "t" and b[0] == "e" and asked[a] == asked[b] and jaccard(pa, pb) >= 0.7}
    assert len(want) >= 40
    odd = [{"example_id": "n1", "prompt": None, "split": "test"}, {"example_id": None, "prompt": data[0][1], "split": "test"}, {"example_id": "n2", "prompt": "", "split": "test"}, {"example_id": "n3", "prompt": data[0][1], "split": "all"}, {"example_id": "n4", "prompt": data[0][1], "split": None}, {"example_id": "n5", "prompt": story(r, 3000), "split": "test"}]
    df = prompts(spark, [{"example_id": i, "prompt": p, "split": s, "source": None} for i, p, s in [*data, *data[:2]]] + odd)
    assert rows(split_overlap.found_pairs(df)) == want
    report = split_overlap.overlap_report(df).collect()
    assert sum(x.overlapping for x in report) == 40 and sum(x.examples for x in report) == 83
    assert split_overlap.found_pairs(prompts(spark, [])).count() == 0


def test_copies_that_ask_by_a_line_of_their_own(spark):
    text = "The miller sold a clay jug near the quay of Balcor before the harvest"
    data = [("t1", f"{text}\nname the seller", "train"), ("t2", f"{text} name the seller", "train"), ("e1", f"{text}\nname the seller", "test")]
    df = spark.createDataFrame(data, "example_id string, prompt string, split string")
    assert rows(split_overlap.found_pairs(df)) == {("e1", "t1")}  # t2 has the same words, but no line that asks


def test_split_overlap_in_a_hot_passage(spark):
    """Copies whose shared words are all frequent, edited in every sentence by words of their own."""
    r = random.Random(24)
    passage = [sentence(r) for _ in range(10)]
    copies = [" ".join(s.replace(" near ", f" own{n} near " if k % 4 == n % 4 else " near ").replace(" the ", f" the{'' if k % 2 == n % 2 else ' very'} ") for k, s in enumerate(passage)) for n in range(8)]
    data = [{"example_id": f"x{n}", "prompt": f"Story: {c}\nQuestion: Who hid it?\nAnswer:", "split": "test" if n % 2 else "train"} for n, c in enumerate(copies)]
    want = {tuple(sorted((a["example_id"], b["example_id"]))) for a, b in combinations(data, 2) if a["split"] != b["split"] and jaccard(a["prompt"], b["prompt"]) >= 0.7}
    assert len(want) == 16
    assert rows(split_overlap.found_pairs(prompts(spark, data))) == want


@pytest.mark.parametrize(("a", "b", "same"), [("Who sold it?", "Who really sold it", True), ("Who fuond a sall telescope?", "Who found a small telescope?", True), ("What is said of the miller?", "What is said of the tailor?", False), ("", "Who?", False), ("", "", True)])
def test_same_question(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(split_overlap.same_question(F.col("a"), F.col("b"))).first()[0] is same


def test_question_of(spark):
    data = {"Story: A b.\nQuestion: Who sold it?\nAnswer:": "Who sold it?", "A b. C d.\nWho sold it?": "Who sold it?", "Story: A.\nQuestion: Q1? Answer: x \nWho hid it?": "Who hid it?", "Document: A b.\nSummary:": "", "A b.": ""}
    df = spark.createDataFrame([(k,) for k in data], "p string").select("p", split_overlap.question_of(F.col("p")).alias("q"))
    assert dict(rows(df)) == data
    assert {p: broken_pairs.question_of(p) for p in data} == data


def _pieces(text, k=5):
    return sum(-(-len(w) // k) if w[0].isalnum() else 1 for w in re.findall(r"[^\W_]+|[^\w\s]", text))


def test_cut_texts(spark):
    r = random.Random(5)
    full = [f"Story: {story(r, 4)}\nQuestion: Who sold it?\nAnswer:" for _ in range(60)]
    data = [{"example_id": f"p{n}", "prompt": t, "source": "a"} for n, t in enumerate(full)]
    cut = {"c1": full[0][:150], "c2": full[1][37:], "c3": full[2][:99] + "…", "c4": full[3][:120] + " [...]", "c5": story(r)[:80], "c6": full[4][:200].rstrip(". ") + "�"}
    sound = {"s1": story(r), "s2": f"{story(r)}\nWho sold it?", "s3": "", "s4": None, "s5": "...", "s6": full[0].lower(), "s7": full[0] * 300}
    data += [{"example_id": k, "prompt": t, "source": None} for k, t in {**cut, **sound}.items()] + [{"example_id": "c1", "prompt": cut["c1"]}, {"example_id": None, "prompt": cut["c1"]}]
    answers = [f"It was {NAMES[n]} who sold the copper bell near the quay." if n % 2 else f"the miller {NAMES[n]}" for n in range(200)]
    half = answers[3][: answers[3].index("copper") + 3]
    gens = [(f"g{n}", None, t, _pieces(t) + 1, "x") for n, t in enumerate(answers)]
    gens += [("d1", None, answers[1][:30], _pieces(answers[1][:30]), "x"), ("d2", None, answers[1][:20], _pieces(answers[1]) + 1, "x"), ("d3", None, half, _pieces(half) + 2, "x"), ("k1", None, answers[5].rstrip("."), _pieces(answers[5]) + 1, "x"), ("k2", None, None, 3, "x"), ("k3", None, "  ", 1, "x"), ("k4", None, "the miller", None, None), ("d1", None, answers[1][:30], _pieces(answers[1][:30]), "x")]
    g = spark.createDataFrame([(*x, 5, "clash") for x in gens], GENERATIONS)
    out = cut_text.cut_records(prompts(spark, data), g)
    assert rows(out.filter("cut").select("record_table", "record_key")) == {("prompt_response", k) for k in cut} | {("generated_response", k) for k in ("d1", "d2", "d3")}
    assert {x.record_key for x in out.filter("longer_copy").collect()} >= {"c1", "d1", "d2", "d3"}
    rates = {(x.record_table, x.source): (x.records, x.cut) for x in cut_text.cut_rates(prompts(spark, data), g).collect()}
    assert rates["prompt_response", "a"] == (60, 0) and rates["generated_response", "x"][1] == 3
    assert {x.record_key: x.evidence for x in out.filter("cut").collect()} == {"c1": "longer_copy", "c2": "start", "c3": "mark", "c4": "mark", "c5": "end", "c6": "mark", "d1": "longer_copy", "d2": "longer_copy", "d3": "longer_copy"}
    assert all(x.cut == x.by_copy + x.by_mark + x.by_count + x.by_start + x.by_end for x in cut_text.cut_rates(prompts(spark, data), g).collect())
    assert cut_text.cut_records(prompts(spark, []), g.limit(0)).count() == 0


def test_prompts_cut_behind_a_sentence(spark):
    """Closed values with a longer copy are cut, but not whole prompts that an answer follows; responses without count are by any longer copy."""
    r = random.Random(23)
    body = [story(r, 3) for _ in range(4)]
    whole = f"Story: {body[1]}\nQuestion: Who sold it?"
    data = {"cut": f"Story: {body[0]}", "full": f"Story: {body[0]} {sentence(r)}\nQuestion: Who hid it?\nAnswer:", "asked": whole, "label": f"{whole}\nAnswer:", "history": f"{whole}\nAnswer: the miller\nQuestion: Where?\nAnswer:", "alone": f"Story: {body[2]}"}
    answer = "It was the miller who sold the bell near the quay."
    g = spark.createDataFrame([(k, None, t, None, "x", 5, "clash") for k, t in (("g1", answer), ("g2", answer[:22].rstrip()), ("g3", "It was the tailor of the town."))], GENERATIONS)
    out = cut_text.cut_records(prompts(spark, [{"example_id": k, "prompt": t} for k, t in data.items()]), g)
    assert rows(out.filter("cut").select("record_key")) == {("cut",), ("g2",)}
    assert {x.record_key for x in out.filter("longer_copy").collect()} >= {"cut", "g2"}


def test_prefixes_against_brute_force(spark):
    r = random.Random(6)
    values = sorted({story(r, 3)[: r.randrange(5, 160)] for _ in range(150)} | {story(random.Random(n), 3) for n in range(20)} | {story(random.Random(n), 3)[: 20 + 9 * n] for n in range(12)})
    df = spark.createDataFrame([(n, v, True) for n, v in enumerate(values)], "value_id long, text string, open boolean")
    want = {n for n, v in enumerate(values) if len(v) >= 16 and any(w != v and w.startswith(v) for w in values)}
    assert {x.value_id for x in cut_text.longer_copies(df).collect()} == want and want


DOCUMENTS = "doc_id long, text string, lang string, source string, label string, segments int"
FRENCH = ["Le meunier a vendu une lourde échelle près du quai de {}.", "La couturière a perdu la flûte devant la chapelle de {} avant la moisson.", "Qui a caché le vieux journal intime ?"]
GERMAN = ["Die Müllerin verkaufte eine schwere Leiter am Kai von {}.", "Der Gärtner verlor die Flöte vor der Kapelle von {} am 5. Juni.", "Wer versteckte das alte Tagebuch?"]
ENGLISH = ["The miller sold a heavy ladder near the quay of {}.", "The tailor lost the flute outside the chapel of {} before the harvest.", "Who hid the old diary?"]
SPANISH = ["El molinero vendió una escalera pesada junto al muelle de {}.", "La costurera perdió la flauta frente a la capilla de {} antes de la cosecha.", "¿Quién escondió el viejo diario?"]
PORTUGUESE = ["O moleiro vendeu uma escada pesada junto ao cais de {}.", "A costureira perdeu a flauta em frente à capela de {} antes da colheita.", "Quem escondeu o velho diário?"]
TONGUES = {"en": ENGLISH, "fr": FRENCH, "de": GERMAN, "es": SPANISH, "pt": PORTUGUESE}


def said(lang, n, r):
    return " ".join(r.choice(TONGUES[lang]).format(r.choice(NAMES)) for _ in range(n))


def documents(spark, extra=(), n=60):
    r = random.Random(8)
    base = [(1000 + k, said(lang, 4, r), lang if k % 10 else r.choice(list(TONGUES)), "a") for k, lang in enumerate(list(TONGUES) * n)]
    return spark.createDataFrame([(*x, "clash", 1) for x in [*base, *extra]], DOCUMENTS)


def test_languages(spark):
    r = random.Random(9)
    extra = [(1, said("fr", 3, r), "French", "a"), (2, said("fr", 3, r), "de", "a"), (3, said("es", 3, r), None, "a"), (4, f"{said('en', 3, r)}\n{said('de', 3, r)}", "en", "a"), (5, f"{said('en', 3, r)} “La flûte perdue” ({NAMES[5]}).", "en-GB", "a"), (6, ENGLISH[0].format(NAMES[1]), "n/a", "a"), (7, "### 17 ###", None, "a"), (8, "", "fr", "a"), (9, None, None, None), (10, said("pt", 3000, r).upper(), "PT", "a"), (3, said("es", 3, r), None, "a")]
    df = documents(spark, extra)
    found = rows(languages.mislabelled(df).filter("doc_id < 1000"))
    assert found == {(2, "fr"), (3, "es"), (4, "en"), (4, "de"), (6, "en")}
    segments = languages.language_segments(df).filter("doc_id = 4").orderBy("first").collect()
    assert [s.lang for s in segments] == ["en", "de"] and [s["first"] for s in segments] == [0, 3] and all(0 < s.confidence <= 1 for s in segments)
    assert languages.mislabelled(df.limit(0)).count() == 0


def test_held_out_accuracy():
    r = random.Random(10)
    texts, labels = [], []
    for n, lang in enumerate(list(TONGUES) * 80):
        texts.append(said(lang, 3, r))
        labels.append(list(TONGUES).index(lang) if n % 8 else r.randrange(5))
    model = languages.fit_classifier(texts, np.array(labels))
    tests = [(said(lang, 1, r), k) for k, lang in enumerate(TONGUES) for _ in range(60)]
    p = languages.probabilities(model, [t for t, _ in tests])
    assert np.mean(p.argmax(1) == [k for _, k in tests]) > 0.97 and np.allclose(p.sum(1), 1)


def test_labels(spark):
    want = {"en": "en", " EN ": "en", "en_US": "en", "German": "de", "fr-FR": "fr", None: "", "n/a": "", "??": "", "und": "", "ru": "other"}
    df = spark.createDataFrame([(k,) for k in want], "l string").select("l", read_label(F.col("l")))
    assert dict(rows(df)) == want


def test_broken_pairs(spark):
    r = random.Random(11)
    context = "The miller Balcordra sold a heavy ladder near the quay of Fengri. The tailor lost the flute outside the chapel of Holjas before the harvest."
    ask = f"Story: {context}\nQuestion: Who sold a heavy ladder?\nAnswer:"
    sound = ["It was the miller who sold a heavy ladder.", "the miller Balcordra", "yes", "unknown", "CANNOTANSWER", "near the quay of Fengri", 'He told them: "I cannot swim", and stayed ashore.', "Sorry was the only word Balcordra said"]
    data = [{"example_id": f"s{n}-{k}", "prompt": ask, "response": f"{t}." if k == 7 and n else t} for n in range(30) for k, t in enumerate(sound)]
    bad = {"e1": (None, "empty"), "e2": ("  ", "empty"), "e3": ("N/A", "empty"), "e4": ("[]", "empty"), "r1": ("I'm sorry, but I cannot help with that.", "refusal"), "r2": ("Lo siento, pero no puedo responder a esta pregunta.", "refusal"), "q1": ("who sold a heavy  ladder", "copied_question"), "q2": ("Question: Who slod a heavy ladder?", "copied_question"), "l1": ("Die Müllerin verkaufte eine schwere Leiter am Kai.", "other_language"), "t1": ("It was the miller Balcor", "truncated"), "t2": ("It was the miller who sold a heavy ladder. The tailor lost", "truncated"), "t3": ("It was the miller who…", "truncated")}
    data += [{"example_id": k, "prompt": ask, "response": t} for k, (t, _) in bad.items()] + [{"example_id": None, "prompt": ask, "response": None}, {"example_id": "n1", "prompt": None, "response": "near the quay of Fengri"}, {"example_id": "e1", "prompt": ask, "response": None}, {"example_id": "long", "prompt": ask, "response": "It was the miller who sold it. " * 3000}]
    g = spark.createDataFrame([("g1", ask, "It was the miller who sold it.", 99, "x", 1, "clash"), ("g2", ask, None, None, None, 1, "clash")], GENERATIONS)
    out = broken_pairs.broken_pairs(prompts(spark, data), g, documents(spark))
    assert {x.record_key: x.defect for x in out.filter("record_table = 'prompt_response'").collect()} == {k: d for k, (_, d) in bad.items()}
    assert rows(out.filter("record_table = 'generated_response'").select("record_key", "defect")) == {("g2", "empty")}
    assert broken_pairs.broken_pairs(prompts(spark, []), g.limit(0), documents(spark).limit(0)).count() == 0
    assert r


def test_markov_clusters(spark):
    rng = np.random.default_rng(12)
    middles = rng.normal(0, 6, (6, 24))
    data = [(f"k{c}-{n}", [float(x) for x in middles[c] + rng.normal(0, 0.5, 24)]) for c in range(6) for n in range(60 if c else 400)]
    strays = [(f"stray{n}", [float(x) for x in rng.normal(0, 30, 24)]) for n in range(4)]
    odd = [("null", None), ("short", [1.0] * 23), ("nan", [float("nan")] * 24), ("zero", [0.0] * 24), ("inf", [float("inf")] + [1.0] * 23), (None, [1.0] * 24), data[0]]
    df = spark.createDataFrame([(*d, "clash", 1) for d in data + strays + odd], "example_id string, v array<float>, key string, cluster int")
    members, clusters = markov_clusters.cluster_vectors(df)
    centroids = spark.createDataFrame([(c, [float(x) for x in middles[c] + 0.3], "train") for c in range(4)], "cluster_id int, centroid array<float>, fit_scope string")
    named = dict(rows(markov_clusters.name_clusters(members, clusters, centroids)))
    assert named == {k: int(k[1]) for k, _ in data if int(k[1]) < 4}
    told = markov_clusters.describe_clusters(members, clusters).orderBy(F.desc("size")).first()
    assert told["size"] >= 400 and len(told.typical) == 5 and all(k.startswith("k0") for k in told.typical)
    members, clusters = markov_clusters.cluster_vectors(df.limit(0))
    assert markov_clusters.name_clusters(members, clusters, centroids).count() == 0 and markov_clusters.describe_clusters(members, clusters).count() == 0


def agreement(a, b):
    """Adjusted agreement of two divisions (1: equal, 0: by chance)."""
    pairs = lambda counts: (counts * (counts - 1) / 2).sum()
    _, x = np.unique(a, return_inverse=True)
    _, y = np.unique(b, return_inverse=True)
    both, one, two, n = pairs(np.unique(x * (y.max() + 1) + y, return_counts=True)[1]), pairs(np.bincount(x)), pairs(np.bincount(y)), len(x)
    chance = one * two / (n * (n - 1) / 2)
    return (both - chance) / ((one + two) / 2 - chance)


@pytest.mark.parametrize("sizes", [[20] * 600, [400] * 40 + [20] * 60, [9000] + [60] * 30])
def test_clusters_of_any_number_and_size(spark, sizes):
    rng = np.random.default_rng(14)
    middles = rng.normal(0, 3, (len(sizes), 24))
    truth = np.repeat(np.arange(len(sizes)), sizes)
    x = middles[truth] + rng.normal(0, 0.5, (len(truth), 24))
    df = spark.createDataFrame([(f"x{n}", v) for n, v in enumerate(x.tolist())], "example_id string, v array<float>")
    members, clusters = markov_clusters.cluster_vectors(df)
    found = {r.key: r.cluster for r in members.select("key", "cluster").collect()}
    assert len(found) == len(x) and agreement(truth, np.array([found[f"x{n}"] for n in range(len(x))])) > 0.97
    assert abs(clusters.count() - len(sizes)) <= 0.03 * len(sizes)


@pytest.mark.parametrize("wide", [30, 4])
def test_no_group_of_strays_is_missed(spark, wide):
    rng = np.random.default_rng(21)
    x = rng.normal(0, wide, (3000, 24))
    groups = [np.arange(n, n + 3 + n % 5) for n in range(0, 400, 10)]
    for g in groups:
        x[g] = x[g[0]] + rng.normal(0, 0.3, (len(g), 24))
    limit = 4.0
    gap = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1), 0))
    dense = (gap <= limit).sum(1) >= markov_clusters.TOGETHER
    df = spark.createDataFrame([(f"x{n}", v) for n, v in enumerate(x.tolist())], "key string, v array<double>")
    found = markov_clusters._more_landmarks(df, limit, 17)
    far = np.sqrt(((x[:, None] - found) ** 2).sum(2))
    assert dense.sum() >= sum(map(len, groups)) and len(found) >= len(groups)
    assert (far[dense].min(1) <= 2 * limit).all() and dense[far.argmin(0)].all()
    assert all(np.sqrt(((a - b) ** 2).sum()) > limit for a, b in combinations(found, 2))


def test_flow_rests_on_attractors(spark):
    rings = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(base, base + 5)] + [(4, 10, 0.01), (10, 4, 0.01)]
    flow = markov_clusters.markov_flow(spark.createDataFrame(rings, "i int, j int, w double"))
    assert all((x.i < 10) == (x.j < 10) for x in flow.collect()) and abs(flow.agg(F.sum("w")).first()[0] - 10) < 1e-6


def sized(spark, n=800):
    r = random.Random(13)
    data = [(k, r.choice(["a", "a", "a", "b", "B ", None, "zz"]), r.choice([1, 5, 40, 90, 100, 101, 250])) for k in range(n)] + [(n, "a", 0), (n + 1, "b", 5000)]
    return spark.createDataFrame(data, "doc_id long, source string, tokens int")


def test_packing_loses_and_splits_nothing(spark):
    capacities = spark.createDataFrame([("s", 100), ("l", 300), ("bad", 0)], "pack_name string, capacity_tokens int")
    items = sized(spark)
    out = packing.packed_texts(items, capacities)
    held = out.collect()
    tokens = {x.doc_id: x.tokens for x in items.collect() if x.tokens}
    for name, capacity in (("s", 100), ("l", 300)):
        own = [x for x in held if x.pack_name == name]
        fill, per = {}, {}
        for x in own:
            fill[x.container] = fill.get(x.container, 0) + x["size"]
            per.setdefault(x.doc_id, []).append(x["size"])
        assert {d: sum(s) for d, s in per.items()} == tokens and max(fill.values()) <= capacity
        assert all(len(s) == -(-tokens[d] // capacity) for d, s in per.items())
        assert all(abs(x.fill - fill[x.container] / capacity) < 1e-9 for x in own)
        assert sum(tokens.values()) / (len(fill) * capacity) > 0.93
    assert {x.pack_name for x in held} == {"s", "l"}
    assert rows(out) == rows(packing.packed_texts(items, capacities))
    assert packing.packed_texts(items.limit(0), capacities).count() == 0
    assert {x.pack_name: x.tokens for x in packing.pack_report(out).collect()} == {"s": sum(tokens.values()), "l": sum(tokens.values())}


def test_mixing_meets_shares_and_repeats(spark):
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3), ("none", 0.2, 1)], "source string, target_share double, max_repeats int")
    items = sized(spark, 4000)
    out = mixing.mixed_texts(items, targets, rows_per_bucket=300)
    got = {x.source: x for x in mixing.mix_report(out, items, targets).collect()}
    assert set(got) == {"a", "b"} and got["b"].most_copies <= 3 and got["a"].most_copies <= 2
    assert abs(got["a"].actual_share - 0.5) < 0.03 and rows(out) == rows(mixing.mixed_texts(items, targets, rows_per_bucket=300))
    assert all(x.copies >= 1 for x in out.collect()) and out.count() == out.select("doc_id").distinct().count()
    assert mixing.mixed_texts(items.limit(0), targets).count() == 0 and mixing.mixed_texts(items, targets.limit(0)).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Who sold it, then?", "a"), (2, None, None), (3, "", "a"), (None, "x", "a"), (1, "Who sold it, then?", "a"), (4, "word " * 20000, "a")], "doc_id long, text string, source string")
    assert {x.doc_id: x.tokens for x in with_tokens(df, None).collect()} == {1: 6, 2: 0, 3: 0, 4: 20000}
    assert with_tokens(df.limit(0)).count() == 0


@pytest.mark.parametrize("query", [queries.p7_packed, queries.p7_report, queries.p8_mixed, queries.p8_shares])
def test_a_missing_tokenizer_is_no_result(spark, tmp_path, monkeypatch, query):
    df = spark.createDataFrame([(1, "Who sold it, then?", "a")], "doc_id long, text string, source string")
    broken = tmp_path / "broken.json"
    broken.write_text("{")
    with pytest.raises(Exception, match="(?i)EOF|parsing|expected"):
        with_tokens(df, str(broken))
    monkeypatch.setattr(queries, "with_tokens", lambda documents: with_tokens(documents, str(tmp_path / "none.json")))
    with pytest.raises(FileNotFoundError, match="none.json"):
        query(spark, "/root/testdata/sf0.001")
    assert with_tokens(df, "").first().tokens == 6


@pytest.mark.parametrize("query", [queries.p8_mixed, queries.p8_shares])
def test_an_empty_tokenizer_name_is_no_result(spark, monkeypatch, query):
    monkeypatch.setattr(queries.token_sizes, "TOKENIZER", "")
    monkeypatch.setattr(queries, "with_tokens", lambda documents: with_tokens(documents, ""))
    with pytest.raises(ValueError, match="LUMENAR_TOKENIZER"):
        query(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(queries.token_sizes, "TOKENIZER", "none")
    monkeypatch.setattr(queries, "with_tokens", lambda documents: with_tokens(documents, "none"))
    assert query(spark, "/root/testdata/sf0.001").count() > 0


def test_a_table_replaces_the_one_before(spark):
    first = cut_lineage(spark.range(5).toDF("n"))
    second = cut_lineage(first.selectExpr("n + 1 as n"), instead_of=first)
    assert sorted(x.n for x in second.collect()) == [1, 2, 3, 4, 5]


def test_queries_are_named_by_problem():
    names = queries.queries()
    assert all(re.match(r"p[1-9]_", n) for n in names) and {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9)} <= set(names) and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("prompt_response", "toy_xsum"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = {tuple(r) for r in db.execute(queries.oracle_sql()[name]).fetchall()}
    assert want and rows(queries.queries()[name](spark, folder)) == want
