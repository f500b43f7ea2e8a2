"""Training-data operators against plain versions, and on rows with nulls, blanks, ties and clashing columns."""

import math
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docketlake.llm import base, bpe, decontaminate, graph, html, language, licence_texts, licences, near_dup, pii, queries, substrings, tool_calls, vectors

SF = "/root/testdata/sf0.001"
WORDS = "the of and river stone light house green table window paper garden story number people water summer winter morning evening".split()


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with copies, near copies, shared passages, nulls, blanks and one very long word list; other columns clash with result names."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))
    base = [say(80) for _ in range(12)]
    passage = say(60)
    texts = base + base[:4] + [b.replace(b.split()[40], "changed", 1) for b in base[:6]] + [f"{say(20)} {passage} {say(20)}" for _ in range(4)]
    texts += [None, "", " \n\t", "one two", "one  two", say(30_000), "x" * 50_000, "12 34 !!"]
    rows = [(i, t, ["en", "de", None][i % 3], "src", 0, "n", "c", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string, kept int, doc string, component_id string, score double")


def _components(ids, links):
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, leaf=4).collect()}
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = _components(sets, links)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(9)
    a, b = (" ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(200)) for _ in range(2))
    rows = [(5, a), (5, b), (7, a + " end"), (8, b + " end"), (5, None), (None, a), (9, b), (4, b + " x y"), (9, "alone")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"]) for r in got), key=str)
    assert found == sorted([(5, True, 4, False), (5, True, 4, False), (7, True, 4, False), (8, True, 4, False), (5, False, 5, True), (None, True, None, None), (9, True, 4, False), (4, True, 4, True), (9, True, 4, False)], key=str)


def test_components_of_long_paths_and_empty_tables(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (7, 7), (None, 3)], "a long, b long")
    for hub_edges in (graph.HUB_EDGES, 1):
        assert {r["id"]: r["component_id"] for r in graph.components(edges, hub_edges=hub_edges).collect()} == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}
    stars = spark.createDataFrame([(9_000, i) for i in range(0, 300)] + [(1_000, i) for i in range(1_001, 1_300)] + [(9_000, 1_299)], "a long, b long")
    found = graph.components(stars, hub_edges=50).collect()
    assert len(found) == 601 and {r["component_id"] for r in found} == {0}
    assert graph.components(edges.limit(0)).count() == 0


def test_remove_repeats(docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs).collect()}
    words = {r["doc_id"]: (r["text"] or "").split() for r in docs.collect()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        assert got[i] == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))


def test_remove_repeats_with_frequent_prefixes(spark, docs):
    few = docs.select(F.col("doc_id").alias("doc"), "text")
    usual = {tuple(r) for r in substrings.repeated_suffixes(few, 13).selectExpr("doc", "start", "bits").collect()}
    starts = lambda rows: {(d, s + i) for d, s, b in rows for i in range(8) if b >> i & 1}
    assert starts(usual) == starts(tuple(r) for r in substrings.repeated_suffixes(few, 13, group_rows=1).collect()) != set()


def test_remove_repeats_without_ids_and_with_equal_codes(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(None, passage), (None, passage), (1, passage), (2, "x " + passage)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("1", 0), ("2", 20), ("None", 0), ("None", 0)]
    codes = np.arange(13, dtype=np.uint32).tobytes()
    check = lambda c: np.array([c], dtype=np.uint32).tobytes()
    found = substrings.deep_nodes([(5, b"\0" + codes + check(c), d) for c, d in ((1, 9), (2, 3), (1, 7))], 13)
    assert [f[2] for f in found] == [[7], [3], [7]]  # a suffix of equal codes whose check differs is another node


def test_edit_matching_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        item, window = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, n))) for n in (20, 60))
        row = [0] * (len(window) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(window, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
        assert decontaminate.best_match(item, window)[0] == min(row)


def test_decontamination(spark, docs):
    item = "a passage of a benchmark that somebody may have copied into a page of the web, with a small change in it"
    rows = [(1, "x " * 50 + item.upper().replace("SOMEBODY", "SOMEBODI") + " y"), (2, "nothing of it"), (3, None), (4, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "!!")], "item_id long, text string")
    for block in (4_000_000, 10):
        assert [tuple(r)[:3] for r in decontaminate.contaminated(documents, items, block_chars=block).collect()] == [(1, 7, 1)]
    assert decontaminate.contaminated(documents.limit(0), items).count() == 0 and decontaminate.contaminated(documents, items.limit(0)).count() == 0


def test_blocks_of_items_are_bounded_and_lose_nothing(spark):
    """Repeated ids, repeated texts and one very long item, held against repeated documents in one block and in many."""
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i % 5, say(12)) for i in range(60)]
    items += items[:10] + [(9, say(900)), (5, items[0][1].upper() + "!"), (6, None), (None, "river stone")]
    rows = [(i % 40, f"{say(4)} {items[i % 60][1].replace('a', 'e', i % 2)}, {items[-4][1]}") for i in range(80)] + [(None, items[3][1]), (90, "")]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontaminate.contaminated(docs, bench).collect(), key=str)
    many = decontaminate.contaminated(docs, bench, block_chars=400)
    assert many.columns == ["doc_id", "item_id", "distance", "budget", "end_char"] and sorted(many.collect(), key=str) == whole and len(whole) > 160
    clean = spark.createDataFrame([(i, decontaminate.normalise(t)) for i, t in items if t and i is not None], "id long, text string").distinct()
    total = clean.agg(F.sum(F.length("text"))).first()[0]
    blocks = [b.collect() for b in decontaminate._blocks(clean, total, 400)]
    assert sorted(r for b in blocks for r in b) == sorted(clean.collect())
    alone = [len(b) for b in blocks if any(len(r["text"]) > 400 for r in b)]
    assert alone == [1] or max(sum(len(r["text"]) for r in b if len(r["text"]) <= 400) for b in blocks) <= 400
    assert decontaminate.contaminated(docs, bench.limit(0), block_chars=1).count() == 0


def _edits(item, text):
    """Least edit distance of the item to any part of the text that begins and ends at words, by rows."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_matcher_against_dynamic_programming(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, say(rng.randint(1, 14))) for i in range(25)] + [(25, "cat"), (None, "stone light"), (26, "  ")]

    def spoil(text):
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice(["", "q", text[k] + "z"]) + text[k + 1 :]
        return text

    texts = [f"{say(5)} {spoil(rng.choice(items[:25])[1])} {say(5)}" for _ in range(60)] + ["concatenate the cats", "a Cat!", "", None, say(40_000)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "my cat", "clash"), (61, "a Cat!", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc, text, _ in rows:
        for item, words in items:
            said = f" {words.strip()} "
            budget = int(len(words) * 0.05)
            if item is None or not words.strip() or not text or len(text) > 10_000:
                continue
            distance = _edits(said, f" {decontaminate.normalise(text)} ")
            if distance <= budget:
                want.append((doc, item, distance, budget))
    for block in (4_000_000, 300):
        got = [tuple(r)[:4] for r in decontaminate.contaminated(docs, bench, block_chars=block).collect() if r["doc_id"] != 64]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert (61, 25, 0, 0) in want and (60, 25, 0, 0) not in want and (None, 25, 0, 0) in want


def test_disguises_and_odd_digits(spark):
    spans = lambda t: pii.write(pii.all_spans(t)[1])
    for t in ("john@\tmail.com", "john\xa0@\xa0mail.com", "john [ \tat ] mail.com", "john@mail [dot] com", "john@mail dot com", "john at mail [ . ] com", "john {at} mail (dot) com"):
        assert spans(t) == f"email:0:{len(t)}", t
    assert spans("0" * 5000 + "1.2.3.4 256.1.1.1 " + "9" * 5000 + ".1.1.1") == "ip:0:5007"
    assert spans("look at example.com now. we met at noon.then home") == ""
    assert spans("call «plus one five zero nine five five five six nine seven three» or ten") == "phone:6:65"
    many = pii.all_spans("1.2.3.4 1 dot 2 dot 3 dot 4 " * 20_000)
    assert len(many[0]) == 20_000 and len(many[1]) == 40_000
    words = ["one", "two ", "Dot ", "at", "@", " ", "[", "]", "(", ")", "a", ".", "5", "-", ",", "\t", "\xa0", "«", "plus ", "\u017fix ", "f\u0131ve ", "é", "com", "mail", "_", "œ", "point ", "0", "а", "punto ", " arroba ", "aroba\u017fe", "pun\u212at "]
    rng, changed = random.Random(6), 0
    for _ in range(20_000):
        text = "".join(rng.choice(words) for _ in range(rng.randint(1, 24)))
        for step, may in ((pii.spelled_digits, pii.may_be_spelled), (pii.at_and_dot, pii.may_be_addressed)):
            tape = pii.Tape(text)
            step(tape)
            assert may(text) or tape.text == text
            changed += tape.text != text
    assert changed > 50


def test_spelled_ips_references_stops_and_lettered_digits():
    """Each disguise is one span that covers it whole; what only looks like one stays clean."""
    whole = {
        "ip": ["one nine two dot one six eight dot one dot one", "one-nine-two dot one six eight point one, dot, one", "uno nueve dos punto uno seis ocho punto cero punto uno", "eins null punkt null punkt null punkt acht", "zero dot two five five dot zero dot nine"],
        "email": ["john@mail。com", "john@mail｡example․org", "john&#64;mail.com", "john&#x40;mail&period;com", "john&commat;mail&#46;com", "john arroba mail punto com", "juan arroba mail.com", "jean (arobase) mail point fr", "jean AROBASE mail point fr", "hanѕ@mаil.de", "jim@mаιl.org"],
        "card": ["4111 1111 1111 1I11", "41l1-1111-1111-1111", "5000 OO00 0000 0009"],
        "phone": ["+1 5O9 555 5697", "+44 2O79 46O 958"],
    }
    for kind, texts in whole.items():
        for t in texts:
            if kind == "card":
                digits = re.sub(r"[ -]", "", t.translate(str.maketrans("OoIl", "0011")))
                assert pii.luhn(digits), t
            base, spans = pii.all_spans(f"see {t}; ok")
            assert base == [] and f"{kind}:4:{4 + len(t)}" in pii.write(spans).split(","), (t, pii.write(spans))
            assert f"{kind}:0:{len(t)}" in pii.write(pii.all_spans(t)[1]).split(",")
    for t in ("one nine two dot one six eight dot one", "three zero zero dot one dot one dot one and so on", "a。b。c", "好@b。下一句", "&#9;&#200;&amp;", "pesa una arroba y media. punto", "meet at home point blank", "4111 1111 1111 111 I think", "5OO OIl OOO OIl", "Il0 lO1"):
        spans = pii.all_spans(t)[1]
        assert [s for s in spans if s[1] != 1] == [], (t, pii.write(spans))
    assert pii.all_spans("three zero zero dot one dot one dot one")[1] == [(11, 1, 39)]  # digits of a part over 255 stay apart
    long = "one nine two dot one six eight dot one dot one, " * 5000 + "1O" * 20_000
    began = time.perf_counter()
    assert len([s for s in pii.all_spans(long)[1] if s[1] == 1]) == 5000 and time.perf_counter() - began < 10


def test_added_spans_against_plain_version():
    """Every disguise of an identifier is found where it stands, in any surroundings, and base spans stay."""
    rng = random.Random(7)
    names, at, dots = ["john", "mary.ann", "x_1"], ["@", " at ", " [at] ", "(at)", " @ "], [".", " dot ", "[dot]", " ( . ) "]
    for _ in range(3000):
        a, d = rng.choice(at), rng.choice(dots)
        if a == " at " and d == ".":
            continue
        disguise = f"{rng.choice(names)}{a}mail{d}example{rng.choice([d, '.'])}org"
        spelled = " ".join(rng.choice([str(n), list(pii.DIGIT_WORDS)[n + 1 if n else 0]]) for n in [rng.randint(0, 9) for _ in range(10)])
        before, between = "Write, please: ", "; or call: "
        text = before + disguise + between + "plus " + spelled + "!"
        base, spans = pii.all_spans(text)
        lo = len(before)
        assert set(base) <= set(spans) and (lo, 0, lo + len(disguise)) in spans, text
        assert (lo + len(disguise) + len(between), 3, len(text) - 1) in spans, text


def test_personal_data(spark):
    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = re.sub(r"\D", "", m[0])
            out += [(m.start(), 2, m.end())] if 12 <= len(digits) <= 19 and pii.luhn(digits) else []
        return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15])

    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("ab@@..11 25-+()5") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain(t)
    texts = ["john dot doe at mail dot example dot com", "јоhn@mаil.com", "plus one five zero nine five five five six nine seven three", "we met at noon. dot", None, "", "a@b.org, 10.0.0.1"]
    rows = pii.find(spark.createDataFrame(enumerate(texts), "doc_id long, text string").withColumn("spans", F.lit(1)), clean_col="clean").orderBy("doc_id").collect()
    assert [r["spans"] for r in rows] == ["email:0:40", "email:0:13", "phone:0:59", "", "", "", "email:0:7,ip:9:17"]
    assert rows[6]["clean"] == "[EMAIL], [IP]" and rows[4]["clean"] is None and rows[6]["n_email"] == 1


def test_bpe_matches_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    theirs, ours = Tokenizer.from_file(path), bpe.PrefixBPE(bpe.load_vocabulary(path))
    rng = random.Random(4)
    for _ in range(1500):
        t = "".join(rng.choice("ab  \n\t'sétßñ123,._!?日本語🙂<|endoftext|>Ⅷ½\x1c\x85") for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>"])
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert (ours.encode(t)[0].tolist(), ours.encode(t)[1], ours.decode(ids)) == (ids, t, t)
    for r, t in zip(bpe.encode(docs, path).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True):
        assert r["ids"] == theirs.encode(t["text"] or "", add_special_tokens=False).ids and r["decoded"] == (t["text"] or "")


def test_language(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(table.where(~language.held_out()), "text", "lang")
    rows = [r for r in language.predict(table, model).withColumn("out", language.held_out()).collect() if r["out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    odd = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).where("text is null or not text rlike '[a-z]'").collect()}
    assert set(odd.values()) == {"und"} and len(odd) == 4
    nothing = language.fit(table.limit(0), "text", "lang")
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}


def test_language_sample_of_a_large_table(spark):
    """A share of less than one in a million still learns; a sample without a row is an error and no silent `und`."""
    word = F.element_at(F.array(*[F.lit(w) for w in ("the house of stone", "das Haus aus Stein")]), (F.col("id") % 2 + 1).cast("int"))
    rows = spark.range(3_000_000).select(F.concat_ws(" ", word, "id").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    assert language.fit(rows, "text", "lang", max_rows=60).languages == ["de", "en"]
    few = sum(len(language.fit(rows.where(f"id % 2 = {k}"), "text", "lang", max_rows=4).languages) for k in (0, 1))
    assert few == 2
    with pytest.raises(ValueError, match="empty"):
        language.fit(rows.where("id % 2 = 0"), "text", "lang", max_rows=0)


def test_language_against_plain_naive_bayes(spark):
    assert not any(map(language.has_letter, ["½ ² ③", "12", "", None, "_ 3 !"])) and all(map(language.has_letter, ["½a", "語"]))
    table = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null").select("text", "lang")
    rows = table.collect()
    model = language.fit(table, "text", "lang")

    def buckets(text):
        out, code = [], [ord(c) * 0x9E3779B1 % 2**32 for c in text.lower()]
        for n in language.ORDERS:
            for i in range(len(code) - n + 1):
                h = n
                for c in code[i : i + n]:
                    h = (h ^ c) * 0x85EBCA6B % 2**32
                    h ^= h >> 13
                out.append(h >> 18)
        return out

    counts, docs = {}, {}
    for r in rows:
        mine = counts.setdefault(r["lang"], [0.5] * language.BUCKETS)
        docs[r["lang"]] = docs.get(r["lang"], 0) + 1
        for b in buckets(r["text"]):
            mine[b] += 1
    logs = {x: np.log(np.array(c) / sum(c)) for x, c in counts.items()}
    texts = [r["text"] for r in rows[:60]] + ["½", "der", None, "la casa"]
    for text, best, score in zip(texts, *model.predict(texts), strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (best, score) == ("und", 0.0)
            continue
        sums = {x: float(logs[x][buckets(text)].sum()) + math.log(docs[x] / len(rows)) for x in sorted(logs)}
        want = max(sums, key=sums.get)
        assert best == want and math.isclose(score, 1 / sum(math.exp(v - sums[want]) for v in sums.values()), rel_tol=1e-9, abs_tol=1e-12)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    made = [c + 0.05 * rng.standard_normal(16) for c in centres for _ in range(int(rng.integers(1, 8)))]
    made += [made[0], made[0], np.zeros(16)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(900, None), (901, []), (902, [math.nan] * 16), (903, [None] * 16), (904, [1.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=4).collect()}
    links = []
    for i, a in enumerate(made):
        for j, b in enumerate(made[:i]):
            if a.any() and b.any() and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links.append((j, i))
    want = _components([r[0] for r in rows], links)
    assert got == {i: (sum(i in x for x in links), want[i]) for i in want}


def test_vectors_of_extreme_lengths_and_repeated_ids(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 1e180]), (4, [0.0, 1e-310]), (4, [0.0, 5.0]), (None, [1.0, 0.0]), (5, [math.inf, 1.0]), (6, [0.0, -1.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str)
    assert found == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True), (None, 0, None, None), (5, 0, 5, True), (6, 0, 6, True)], key=str)


def test_ranges_of_a_pass_find_lone_pairs():
    assert [vectors.outer_passes(n, 0.9, 0.001) for n in (0, 30_000, 51_282, 10_000_000)] == [2, 2, 5, 13]
    rng = np.random.default_rng(12)
    a, b = rng.standard_normal((2, 10_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    for cosine in (0.9001, 0.92, 0.95):
        points = np.concatenate([a, cosine * a + math.sqrt(1 - cosine**2) * b])
        scale = (np.abs(points).max(axis=1, keepdims=True) / 127).astype(np.float32)
        small = np.rint(points / scale).astype(np.int8)
        lost = np.linalg.norm(points - small * scale.astype(float), axis=1).astype(np.float32)[:, None]
        sure, unsure = vectors.range_links(np.concatenate([scale.view(np.int8), lost.view(np.int8), small], axis=1), 3, 0.9, 64)
        met = {tuple(sorted(p)) for p in [*sure.tolist(), *unsure.tolist()]}
        assert sum((i, i + 10_000) not in met for i in range(10_000)) <= 10_000 * vectors.INNER_MISS
        assert all(j == i + 10_000 for i, j in map(sorted, sure.tolist()))


def test_vector_passes_grow_with_the_table(spark):
    assert [vectors.needed_passes(n, 0.9, 16, 0.001, 24) for n in (0, 10, 2_000, 10_000_000)] == [24, 24, 24, 134]
    rng = np.random.default_rng(11)
    a, b = rng.standard_normal((2, 2500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    points = np.concatenate([a, 0.901 * a + math.sqrt(1 - 0.901**2) * b])  # row i and row i + 2500 are a lone pair
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in vectors.near_duplicates(rows, window=1).collect()}
    assert sum(got[i] != got[i + 2500] for i in range(2500)) <= 12


def _around_a_mean(n, pairs, mean, cosine, dim=64):
    """n unit vectors of a mean cosine, and a partner at `cosine` for each of the first `pairs`."""
    rng = np.random.default_rng(5)

    def spread(k):
        e = rng.standard_normal((k, dim))
        e[:, 0] = 0
        return e / np.linalg.norm(e, axis=1, keepdims=True)

    a, b = spread(n), spread(pairs)
    b -= (a[:pairs] * b).sum(axis=1, keepdims=True) * a[:pairs]
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = (cosine - mean) / (1 - mean)
    every = math.sqrt(1 - mean) * np.concatenate([a, c * a[:pairs] + math.sqrt(1 - c * c) * b])
    every[:, 0] = math.sqrt(mean)
    return every


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.7, 0.8])
def test_vectors_around_a_mean(spark, mean):
    n, pairs = 5000, 500
    every = _around_a_mean(n, pairs, mean, 0.905)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(every)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in vectors.near_duplicates(rows, window=16).collect()}
    assert sum(got[i] == got[n + i] for i in range(pairs)) >= 0.98 * pairs
    cosine = every @ every.T
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(cosine >= 0.9, 1)), strict=True)]
    want = _components(range(n + pairs), links)
    assert all(want[i] == want[c] for i, c in got.items())  # nothing that is not linked meets


def test_ranges_of_vectors_are_bounded_by_bytes():
    for rows, dim in ((10, 64), (2_000_000, 64), (2_000_000, 1024), (10**9, 4096)):
        assert 6 * dim * vectors.range_size(rows, dim) <= vectors.RANGE_BYTES
    assert vectors.range_size(2_000_000, 64) == 500_000 and vectors.beyond(np.array([0.6, 0.0]), 0.9) == pytest.approx((0.9 - 0.36) / 0.64)


def test_odd_vectors_have_values(spark):
    a, b, c = [1.0, 0.0, 0.1], [0.9, 0.1, 0.1], [0.0, 1.0, 0.0]
    rows = [(3, a), (1, b), (7, a), (7, a), (9, c), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (2, [1.0, float("nan"), 0.0]), (None, a), (10, [1.0, 0.0]), (11, a * 400), (12, a * 400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component_id", F.lit("clash")).withColumn("dim", F.lit(1)).withColumn("rep", F.lit(2))
    got = sorted((tuple(r) for r in vectors.near_duplicates(table).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    want = [(3, 3, 1, False), (1, 3, 1, True), (7, 3, 1, False), (7, 3, 1, False), (None, 0, None, None), (11, 1, 11, True), (12, 1, 11, False)]
    want += [(i, 0, i, True) for i in (9, 4, 5, 6, 8, 2, 10)]
    assert got == sorted(want, key=str) and vectors.near_duplicates(table.limit(0)).collect() == []


def test_main_text(spark):
    page = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav>{}<footer>f</footer></body></html>'
    rows = [
        (1, "http://a.org/1", page.format('<div class="ad">x</div><article><h1>T&amp;c</h1><p><b>one<br>two<p>three  \n four<div class="reader comments">no</div></article>')),
        (2, "http://a.org/2", page.format("<p>plain<script>var t='</p>'</script> text</p>")),
        (3, None, None),
        (4, "http://a.org/4", ""),
        (5, "no url", "<div>" * 3000 + "deep"),
    ]
    rows += [(10 + i, "https://b.org/x", f"<body><div><p>Write to us</p></div><p>story {i}</p></body>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 10)] == ["T&c\none two\nthree four", "plain text", "", "", "deep", "story 0"]


def _plain_text(source):
    """Main text of a page whose article has only blocks and inline tags: tags split it, nothing is parsed."""
    source = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", source)
    inside = re.findall(r"(?s)<article>(.*?)</article>", source)
    inside = re.sub(r'(?s)<div class="ad">.*?</div>', "", "".join(inside))
    blocks = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", inside)
    lines = (" ".join(html.entities.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_main_text_against_plain_version(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: _plain_text(r["html"] or "") for r in table.collect()}
    for most in (1_000_000, 0):  # templates broadcast, and joined over salted keys
        got = {r["page_id"]: r["text"] for r in html.main_text(table, min_pages=2, most_broadcast=most, pages_a_key=2).collect()}
        assert got == want and any(want.values())


def test_pages_with_odd_markup():
    text = lambda t: html.Page(t).text(frozenset())
    assert text('<body><aside class="related"><article>teaser</article></aside><article>story</article></body>') == "story"
    assert text('<body><main><p>story</p></main><aside><article>teaser</article></aside></body>') == "story"
    assert text('<div class="has-sidebar"><article><p>story<div class="commentlist">no</div><div class="commentary">yes</div></article></div>') == "story\nyes"
    assert text("<script>if (a<b) x='<p>';</script><p>a<b>c</p><textarea><p>no") == "ac"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table></i>h") == "a\nb\nc\nd\ne\nf\ng\nh"
    wrap = "<body><nav>n</nav>{}<footer>f</footer></body>".format
    story = "<h1>T</h1><p>Main story text.</p><p>It goes on.</p><p>It ends.</p>"
    for layout in ('<article class="post ad-free">{}</article>', '<div class="layout has-sidebar"><div id="content">{}</div></div>', '<div class="page sidebar"><article>{}</article></div>', '<article class="related-work">{}</article>', '<div class="no-comments">{}</div>', '<main class="with-banner"><article id="ad_free">{}</article></main>'):
        assert text(wrap(layout.format(story))) == "T\nMain story text.\nIt goes on.\nIt ends.", layout
    assert text(wrap('<article><p class="social-science">a</p><p class="related-work">b</p><h2 class="notice-of-motion">c</h2><p class="share-links"><a href="x">d</a></p><div class="related-posts">e</div><p class="ad">f</p><p>g</p><p>h</p></article>')) == "a\nb\nc\ng\nh"
    for name in ('id="header"', 'class="search"', 'class="login"', 'class="topbar"', 'class="responses"', 'id="respond"', 'class="comments-area"', 'class="site-nav"'):
        assert text(wrap(f"<div {name}>Bob says hi</div><div>{story}</div>")) == "T\nMain story text.\nIt goes on.\nIt ends.", name
    assert text(wrap(f"<article><p>teaser of another story, which is longer than this one is</p></article><main><article>{story}</article></main>")).startswith("T\nMain")
    assert text(wrap(f"<article><p>teaser</p></article><main>{story}</main>")).startswith("T\nMain")
    assert text(wrap(f"<div><ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul></div>{story}")).startswith("T\nMain")
    assert text('<article><header class="header"><h1>T</h1></header><p>a</p></article>') == "T\na"
    assert text('<p title="foo>Hello</p><p class=\'x>you</p><p a="<b>">all</p>') == "Hello\nyou\nall"
    for hard in ("<a " * 100_000, '<a "' * 100_000, '<a b="' + "<p>" * 100_000, "<!" * 100_000, "<a '" * 100_000, "<div>" * 50_000 + "</span>" * 50_000, "<b>" * 50_000 + "<p>" * 50_000, "<script>" + "<a " * 100_000):
        began = time.perf_counter()
        text(hard)
        assert time.perf_counter() - began < 5


def test_pages_that_repeat_are_long_or_clash(spark):
    long = "<article>" + "<p>words &amp; more</p>" * 20_000 + "</article>"
    rows = [(1, "http://a.org/1", "<article><p>one</p></article>")] * 3 + [(2, "http://a.org/2", long), (None, None, "<p>x</p>"), (3, "http://a.org/3", "<nav>only</nav>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("templates", F.lit(7)).withColumn("text", F.lit(None).cast("binary"))
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in html.main_text(table).collect()), key=str)
    assert got == sorted([(1, "http://a.org/1", "one")] * 3 + [(2, "http://a.org/2", "\n".join(["words & more"] * 20_000)), (None, None, "x"), (3, "http://a.org/3", "")], key=str)


def test_tool_calls(spark):
    say = '{"tool_calls":[{"id":"b","name":"reply","arguments":{"turn":"x"},"parent_id":"a"},{"id":"a","name":"nope","arguments":{"z":1,"a":[1.50]}}]}'
    loop = '{"tool_calls":[{"id":"q","name":"reply","arguments":{"turn":1,"prompt":"p"},"parent_id":"w"},{"id":"w","name":"reply","arguments":[1],"parent_id":"q"}]}'
    rows = [(1, 0, "assistant", say), (1, 1, "tool", '{"tool_call_id":"a","content":"ok"}'), (2, 0, "user", None), (3, 0, "assistant", loop), (4, 0, "assistant", "{"), (1, 0, "assistant", say)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link(*tool_calls.logged_calls(messages), tool_calls.REPLY).collect()}
    assert {k: (r["depth"], r["status"], r["errors"]) for k, r in got.items()} == {
        (1, "a"): (0, "repeated", "unknown tool"),
        (1, "b"): (1, "repeated", "prompt is missing; turn is not integer"),
        (3, "q"): (None, "cycle", None),
        (3, "w"): (None, "cycle", "not an object"),
    }
    assert {k: r["position"] for k, r in got.items()} == {(1, "a"): 0, (1, "b"): 1, (3, "q"): None, (3, "w"): None}
    assert got[1, "a"]["canonical"].startswith('{"arguments":{"a":[1.5],"z":1},"call_id":"a"')


def test_depths_of_chains_and_cycles(spark):
    rows = [(1, str(i), str(i - 1)) for i in range(100)] + [(2, str(i), str((i + 1) % 7)) for i in range(7)] + [(2, "x", "3"), (2, "y", "x"), (2, "z", "none"), (3, "a", "a"), (4, "a", None)]
    got = {(r["conv_id"], r["call_id"]): r["depth"] for r in tool_calls.depths(spark.createDataFrame(rows, "conv_id long, call_id string, parent_id string")).collect()}
    assert got == {**{(1, str(i)): i for i in range(100)}, **{(2, str(i)): None for i in range(7)}, (2, "x"): None, (2, "y"): None, (2, "z"): 0, (3, "a"): None, (4, "a"): 0}
    only = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "conv_id long, call_id string, parent_id string")
    assert [r["depth"] for r in tool_calls.depths(only).collect()] == [None, None]


def test_positions_of_a_hot_conversation(spark):
    rng = random.Random(3)
    rows = [(1, f"c{i}", rng.randint(0, 5), rng.randint(0, 9)) for i in range(3000)] + [(c, f"c{i}", 0, i) for c in range(2, 40) for i in range(3)]
    got = {(r["conv_id"], r["call_id"]): r["position"] for r in tool_calls.positions(spark.createDataFrame(rows, "conv_id long, call_id string, depth long, turn long")).collect()}
    for conv in range(1, 40):
        mine = sorted((d, t, i) for c, i, d, t in rows if c == conv)
        assert [got[conv, i] for _, _, i in mine] == list(range(len(mine)))


def test_word_hashes_and_grouped_texts():
    rng = random.Random(4)
    texts = ["", None, " \t", "a", "a\x00 a", "x" * 70 + " y " + "x" * 70 + "z"] + [" ".join("".join(rng.choices("abé", k=rng.randint(1, 30))) for _ in range(rng.randint(0, 60))) for _ in range(100)]
    for text in filter(None, texts):
        raw = text.encode()
        hashes, places = base.word_hashes(raw)
        assert len(hashes) == len(raw.split()) and len(set(hashes.tolist())) == len(set(raw.split()))
        assert all(raw.startswith(w, p) for w, p in zip(raw.split(), places.tolist(), strict=True))
    every, none = np.full(1 << 10, 2**64 - 1, dtype=np.uint64), np.zeros(1 << 10, dtype=np.uint64)
    for frequent in (none, every):
        alone = [(k, *x[1:]) for k, t in enumerate(texts) if t for x in substrings.Suffixes([t.encode()], 13).segments(every, frequent)]
        for size in (1, 500, 1 << 18):
            grouped = [(first + k, *x) for first, group in base.text_groups(texts, size) for k, *x in substrings.Suffixes(group, 13).segments(every, frequent)]
            assert grouped == alone


def test_licences(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "x Released under the MIT Licence... released under the MIT License", "All rights reserved. cc by, CC-BY", None, "", "general public", "the gnu General Public License"]
    rows = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect()}
    assert [rows[i]["labels"] for i in range(7)] == [["cc-by", "cc-by-nc"], ["mit"], ["cc-by", "reserved"], [], [], [], ["gpl"]]
    assert rows[2]["base"] == [0, 3, 5] and rows[2]["n_words"] == 7 and rows[3]["n_words"] == 0


def test_licence_that_most_rows_carry(spark):
    rows = licences.scan(spark.createDataFrame([(i, f"text {i} released under the mit license") for i in range(10)], "doc_id long, text string")).collect()
    assert [r["labels"] for r in rows] == [["mit"]] * 10


@pytest.mark.parametrize("copies", [1, 4, 300])
def test_labels_do_not_depend_on_other_documents(spark, copies):
    mit = "Copyright 2020 me. " + " ".join(t for label, t, _ in licence_texts.PASSAGES if label == "mit")
    boost = " ".join(t for label, t, _ in licence_texts.PASSAGES if label == "bsl-1.0")
    rows = [(i, mit) for i in range(copies)] + [(-1, boost), (-2, "this software is one")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (["mit"], 1.0) for i in range(copies)) and got[-1] == (["bsl-1.0"], 1.0) and got[-2] == ([], 0.0)


def test_every_passage_has_its_phrase_and_label(spark):
    rows = licences.scan(spark.createDataFrame(enumerate(t for _, t, _ in licence_texts.PASSAGES), "doc_id long, text string")).collect()
    for r in rows:
        label, text, phrase = licence_texts.PASSAGES[r["doc_id"]]
        assert f" {phrase} " in f" {' '.join(licence_texts.words(text))} " and label in r["labels"] and r["score"] == 1.0


def test_cut_licences_against_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = ["licensed under the apache license", "subject to the terms of the mozilla public license v 2 0"]
    for _, notice, _ in licences.TEMPLATES * 4:
        words = notice.split()
        a = int(rng.integers(0, len(words) // 2))
        part = [w if rng.random() < 0.85 else "x" for w in words[a : len(words) - int(rng.integers(0, len(words) // 2))]]
        texts.append(" ".join(["y"] * int(rng.integers(0, 3)) + part + ["of the license"] * int(rng.integers(0, 2))))
    rows = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        words, want = text.split(), []
        for t, (_, notice, phrase) in enumerate(licences.TEMPLATES):
            of, must = notice.split(), phrase.split()
            first = next(k for k in range(len(of)) if of[k : k + len(must)] == must)
            for start in range(-len(of), len(words)):
                same = [0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(of)]
                if all(same[first : first + len(must)]) and sum(same) / len(of) >= 0.6:
                    want.append((t, start, sum(same) / len(of)))
        assert [(x["template"], x["start"], x["share"]) for x in rows[i]["templates"]] == sorted(want), text
    assert rows[0]["labels"] == ["apache-2.0"] and rows[1]["labels"] == ["mpl-2.0"]


def test_licence_base_places_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = "cc by general public license all rights reserved gnu the x".split()
    texts = [" ".join(rng.choice(pool, rng.integers(0, 120))) for _ in range(200)] + ["cc by nc 4 0 " * 3000, "all " * 500 + "rights reserved"]
    rows = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        words = text.split()
        places = sorted(k for p, _ in licences.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert rows[i]["base"] == places
    assert len(rows[200]["templates"]) == 3000 and rows[201]["base"] == [499]


def test_pipeline_against_plain_version(spark):
    """Ids, redacted texts and tokens of every document, by plain versions of the stages."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    texts = {r["doc_id"]: r["text"] for r in table if r["text"] and any(c.isalpha() for c in r["text"])}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.lower().split()]}
    kept = _components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, t in texts.items() if any(f" {x} " in f" {decontaminate.normalise(t)} " for x in items)}
    assert set(got) == {i for i in texts if kept[i] == i and i not in leaked}
    theirs, langs, redacted = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)), {r["doc_id"]: r["lang"] for r in table}, 0
    for i, r in got.items():
        clean, at = [], 0
        for s, k, e in pii.all_spans(texts[i])[1]:  # spans against plain versions: see the tests of op3
            if s >= at:
                clean += [texts[i][at:s], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, e)
        clean = "".join(clean) + texts[i][at:]
        redacted += clean != texts[i]
        assert r["ids"] == theirs.encode(clean, add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) and r["round_trip"] and r["lang"] == langs[i]
    assert redacted > 0


def _odd_documents(spark):
    """Nulls in every column, blanks, repeated rows and ids, one very long text and columns that clash with those of results."""
    long = " ".join(f"word{i % 977} and" for i in range(60_000)) + " a@b.org"
    rows = [(None, "the house by the river of stone " * 5, "en", "s", None), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (4, long, "en", "s", 1), (5, "der Fluss und das Haus am Berg", "de", "s", 1), (5, "another text of the same id", "en", "s", 1), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("doc", "node", "kept", "spans", "ids", "lang_pred", "component_id", "item_id", "words", "rep", "digest", "clean"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


OPERATORS = {
    "near_duplicates": lambda d: near_dup.near_duplicates(d),
    "personal_data": lambda d: pii.find(d, clean_col="clean"),
    "language": lambda d: language.predict(d, language.fit(d, "text", "lang")),
    "licences": lambda d: licences.scan(d),
    "repeats": lambda d: substrings.remove_repeats(d),
    "bpe": lambda d: bpe.encode(d, public_tokenizers.path(queries.TOKENIZER)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_documents(spark, name):
    odd = _odd_documents(spark)
    found = OPERATORS[name](odd)
    assert sorted((r["doc_id"] for r in found.select("doc_id").collect()), key=str) == sorted((r["doc_id"] for r in odd.collect()), key=str)
    empty = OPERATORS[name](odd.limit(0))
    assert empty.count() == 0 and empty.columns == found.columns


def test_values_of_odd_documents(spark):
    """What nulls, blanks, repeated rows and ids, a very long text and clashing columns give, row by row."""
    from tokenizers import Tokenizer

    odd = _odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    taken = lambda found, *names: sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr)
    words = [(i, (t or "").split()) for i, t in rows]
    shingles = lambda w: len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0
    want = [(i, shingles(w), 3 if i == 4 else i, None if i is None else i != 4) for i, w in words]
    assert taken(OPERATORS["near_duplicates"](odd), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    want = [(i, len(w), len(w) if i == 4 else 0, "" if i == 4 else " ".join(w)) for i, w in words]
    assert taken(OPERATORS["repeats"](odd), "doc_id", "n_words", "n_removed", "kept_text") == sorted(want, key=repr)
    email = lambda t: f"email:{len(t) - 7}:{len(t)}" if t and t.endswith("a@b.org") else ""
    want = [(i, int(bool(email(t))), 0, email(t), t and t.replace("a@b.org", "[EMAIL]"), "clash") for i, t in rows]
    assert taken(OPERATORS["personal_data"](odd), "doc_id", "n_email", "n_phone", "spans", "clean", "node") == sorted(want, key=repr)
    want = [(i, len(w), [], [], 0.0) for i, w in ((i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) for i, t in rows)]
    assert taken(OPERATORS["licences"](odd), "doc_id", "n_words", "base", "labels", "score") == sorted(want, key=repr)
    theirs = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = [(i, theirs.encode(t or "", add_special_tokens=False).ids, t or "", "clash") for i, t in rows]
    assert taken(OPERATORS["bpe"](odd), "doc_id", "ids", "decoded", "spans") == sorted(want, key=repr)
    for r in OPERATORS["language"](odd).collect():
        assert r["node"] == "clash" and ((r["lang_pred"] in ("en", "de") and 0.5 <= r["score"] <= 1) if r["text"] else (r["lang_pred"], r["score"]) == ("und", 0.0))


def test_empty_chats_vectors_and_pages(spark):
    chats = spark.createDataFrame([(None, 0, "user", "a"), (1, None, "user", "b"), (1, 0, None, "c"), (1, 2, "user", None), (1, 2, "user", None)], "conv_id long, turn long, role string, text string").withColumn("status", F.lit(1))
    rows = tool_calls.link(*tool_calls.turn_calls(chats), tool_calls.REPLY).collect()
    assert [(r["call_id"], r["status"], r["errors"]) for r in rows] == [("call-2", "repeated", "prompt is missing; turn is not integer")]
    assert tool_calls.link(*tool_calls.turn_calls(chats.limit(0)), tool_calls.REPLY).count() == 0
    points = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<double>").withColumn("rep", F.lit(0))
    assert vectors.near_duplicates(points).count() == 4 and vectors.near_duplicates(points.limit(0)).count() == 0
    pages = spark.createDataFrame([(None, None, None), (1, None, "<p>x"), (1, None, "<p>x"), (2, "http://a/", "<p>" + "y " * 100_000)], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("salt", F.lit(0))
    assert sorted(r["text"][:3] for r in html.main_text(pages).collect()) == ["", "x", "x", "y y"] and html.main_text(pages.limit(0)).count() == 0


def test_stages_on_odd_and_empty_documents(spark):
    import corpus_pipeline

    odd = _odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, SF)
        assert stage(spark, odd.limit(0), SF).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == odd.columns
        ids = sorted((r["doc_id"] for r in found.select("doc_id").collect()), key=str)
        assert ids == {"language": [3, 3, 4, 5, 5, None], "near_duplicates": [1, 2, 3, 3, 5, 5, None, None]}.get(name, [1, 2, 3, 3, 4, 5, 5, None, None])


def test_near_duplicate_paths_carry_numbers_and_texts_of_one_id_stay_apart(spark):
    from docketlake.llm import near_dup as N

    line = lambda a: " ".join(f"{a}{k}" for k in range(40))
    docs = spark.createDataFrame([(1, line("a")), (2, line("a") + " x"), (3, line("b")), (3, line("a") + " y"), (4, line("b") + " z"), (5, line("c")), (6, "")], "doc_id long, text string")
    each = N.signatures(docs, "doc_id", "text", 5, 32).where("set_key is not null").dropDuplicates(["doc", "set_key"])
    nodes = N.chosen_path_nodes(each.select("doc", "mark", "sig"), 8, 512, 4, 32)
    assert [t for _, t in nodes.dtypes] == ["bigint"] * 3  # no digest travels with a path
    assert each.select("mark").distinct().count() == each.count() == 6
    assert {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}
