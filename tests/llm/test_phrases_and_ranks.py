"""Phrases, divergence of sources and rank-file BPE against plain versions, on rows with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from docketlake.llm import collocations, divergence, keyfilter, queries, rank_bpe

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, phrase string, term string, ids int, n long, rank string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark):
    """Few words, so that phrases recur; nulls, blanks, other scripts, a very long text, long shared terms and repeated rows."""
    rng = random.Random(7)
    words = "red blue Blue green one two three four ÄÖ ünd 漢字 a b".split()
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "'"]) for _ in range(n))
    texts = [say(rng.randint(0, 60)) + rng.choice(["", "New York City ", "new york", "San Jose"]) for _ in range(160)]
    long_term = "x" * 300
    texts += [None, "", " \t\n", "...", say(6000), *[f"{long_term}y"] * 11, *[f"{long_term}z"] * 9, "q" * 5000]
    langs, sources = ["en", "en", "en", "de", None, ""], ["s1", "s2", "s10", None, ""]
    rows = [(i, t, langs[i % 6], sources[i * 7 % 5], "p", "t", 1, 2, "r") for i, t in enumerate(texts)]
    rows += [(900, None, "fr", "s1", "p", "t", 1, 2, "r"), (901, "two words", "fr", "s2", "p", "t", 1, 2, "r"), (None, "no id here", None, None, "p", "t", 1, 2, "r")]
    return spark.createDataFrame(rows + rows[:20], SCHEMA).repartition(5)


def plain_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r["text"] or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for lang in n:
        found = []
        for (l0, p), a in often.items():
            if l0 != lang or any(l1 == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (l1, q), b in often.items()):
                continue
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("chunk,bits", [(collocations.CHUNK, keyfilter.MOST_BITS), (500, 20)])
def test_phrases(docs, chunk, bits):
    got = collocations.collocations(docs, least=6, top=25, chunk=chunk, most_bits=bits)
    assert sorted(map(tuple, got.collect())) == plain_phrases(docs.collect(), 6, 25)
    assert got.count() > 60


def test_a_full_filter_changes_no_phrase(docs, monkeypatch):
    monkeypatch.setattr(keyfilter, "build", lambda keys, **_: np.full(1 << 14, (1 << 64) - 1, dtype=np.uint64))
    assert sorted(map(tuple, collocations.collocations(docs, least=6, top=25).collect())) == plain_phrases(docs.collect(), 6, 25)


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(9_000_000_000_000_000, 3)], "a long, l long")
    assert rows.select(F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + a)")).first()[0] == 2_000_000 * 9_000_000_000_000_000 // 9_000_000_000_000_003


def plain_audit(rows, least, top):
    docs = [(r["lang"] or "", r["source"] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r["text"] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t in held if held[t] >= least)
        v = len(kept)
        counts = {}
        for d in docs:
            if d[0] == lang:
                counts.setdefault(d[1], Counter()).update(t for t in d[2] if held[t] >= least)
        share = lambda c, t: 1 + (10**9 * (c[t] + 2)) // (sum(c.values()) + 2 * v)  # noqa: E731, B023
        gap = lambda p, q: int(Fraction((p - q) ** 2, p + q))
        whole = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = sorted((-sum(gap(share(c, t), share(d, t)) for t in kept), o.encode()) for o, d in counts.items() if o != s)
            terms = sorted((-gap(share(c, t), share(whole, t)), t.encode()) for t in kept if c[t] and share(c, t) > share(whole, t))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("chunk,bits,tile,block,numbered", [(divergence.CHUNK, keyfilter.MOST_BITS, divergence.TILE, divergence.BLOCK_TERMS, 1000), (300, 20, 2, 3, 1000), (300, 20, 2, 3, 5)])
def test_audit(docs, chunk, bits, tile, block, numbered):
    got = divergence.audit(docs, chunk=chunk, most_bits=bits, tile=tile, block_terms=block, most_numbered=numbered)
    want = plain_audit(docs.collect(), 10, 10)
    assert sorted(map(tuple, got.collect())) == want
    assert {w[4] for w in want if w[0] == "fr"} == {0}


def test_kept_terms_are_counted_by_documents(docs):
    relation = divergence.occurrences(docs, "text", "lang", "source", 400)
    got = {(r["lang"], r["term"]): r["n_docs"] for r in divergence.kept_terms(relation, 3).collect()}
    held = Counter((r["lang"] or "", t) for r in docs.collect() for t in set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r["text"] or ""))))
    assert got == {k: n for k, n in held.items() if n >= 3} and any(len(t) > 300 for _, t in got)


def test_rows_of_the_relation_are_bounded_by_bytes_and_documents(spark):
    texts = [(f"{i:04d}".translate({48 + k: 97 + k for k in range(10)}) * 500, "en", f"s{i % 3}") for i in range(60)] + [(None, "de", "s0")] * 5000
    rows = divergence.occurrences(spark.createDataFrame(texts, "text string, lang string, source string").coalesce(1), "text", "lang", "source", 1000).collect()
    assert sum(len(divergence._unpacked(r["owner"])) for r in rows) == 5060 and sum(len(r["terms"].split()) for r in rows) == 60
    assert max(len(r["terms"]) for r in rows) < 1000 * 8 + 2000 + 100 and max(len(divergence._unpacked(r["owner"])) for r in rows) <= 1000


def test_files_of_the_relation_are_read_in_small_parts(docs, tmp_path, monkeypatch):
    """A row group is held whole by whoever writes or reads it, and so is a batch that goes to Python."""
    spark, key, seen = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr(divergence, "GROUP_BYTES", 20_000, raising=False)
    monkeypatch.setattr(divergence, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(divergence, "remove_folder", lambda *_: None)
    monkeypatch.setattr(divergence, "checkpoint", lambda df: seen.append(spark.conf.get(key)) or df.checkpoint())
    rng, before = random.Random(3), spark.conf.get(key)
    texts = [(" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(400)), "en", f"s{i % 3}") for i in range(300)]
    divergence.audit(spark.createDataFrame(texts, "text string, lang string, source string").coalesce(1), chunk=2000)
    groups = [f.metadata.row_group(k).total_byte_size for f in map(pq.ParquetFile, tmp_path.glob("terms-*/*.parquet")) for k in range(f.metadata.num_row_groups)]
    assert sum(groups) > 500_000 and max(groups) < 80_000
    assert {*seen[:-1]} == {str(divergence.BATCH_BYTES)} and spark.conf.get(key) == before


def test_numbers_are_told_apart_by_names(docs, monkeypatch):
    rows = pa.table({"lang": ["en", "en", "de", ""], "term": ["a", "b", "a", "漢字"]})
    numbers = divergence._Numbers(rows)
    assert not numbers.clash() and numbers.of(b"en", [b"b", b"c", b"a"]).tolist() == [1, -1, 0]
    assert numbers.of(b"", ["漢字".encode()]).tolist() == [3] and numbers.of(b"fr", [b"a"]).tolist() == [-1] and numbers.of(b"en", []).tolist() == []
    with monkeypatch.context() as m:
        m.setattr(divergence, "_key", lambda lang, name: 0)
        assert divergence._Numbers(rows).clash() and not divergence._Numbers(rows.slice(0, 1)).clash()
        assert divergence._Numbers(rows.slice(0, 1)).of(b"en", [b"b", b"a"]).tolist() == [-1, 0]  # an equal key of another word
    monkeypatch.setattr(divergence._Numbers, "clash", lambda self: True)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == plain_audit(docs.collect(), 10, 10)


def test_shares_beyond_64_bits(spark):
    rows = spark.createDataFrame([(40_000_000_000, 70_000_000_000, 5)], "n long, total long, kinds long")
    assert rows.select(divergence._share(F.col("n"), "total", "kinds")).first()[0] == 1 + 10**9 * 40_000_000_002 // 70_000_000_010


@pytest.mark.parametrize("operator", [collocations.collocations, divergence.audit])
def test_empty_tables(docs, operator):
    assert operator(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def ranks():
    return rank_bpe.load_ranks(public_tokenizers.path(queries.RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_bpe_of_random_strings(ranks, library):
    rng = random.Random(3)
    kinds = [
        lambda n: "".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(n)),
        lambda n: "".join(rng.choice("ab ") for _ in range(n * 5)),
        lambda n: "".join(rng.choice(" \n\t\r\x0b\x1c\x85\xa0　x1") for _ in range(n)),
        lambda n: rng.choice("a=- é漢") * rng.randint(1, 2000),
        lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n * 20)),
    ]
    texts = [rng.choice(kinds)(rng.randint(0, 60)) for _ in range(2500)] + ["", "<|endoftext|>"]
    coder = rank_bpe.RankBPE(ranks, public_tokenizers.PATTERN, limit=1000)
    for k in range(0, len(texts), 400):
        for text, ids in zip(texts[k : k + 400], coder.encode(texts[k : k + 400]), strict=True):
            ids = np.frombuffer(ids, dtype=np.int32).tolist()
            assert ids == library.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_rank_bpe_where_merges_make_pairs_of_lower_rank():
    """Ranks in which a merge can make a pair that goes before its equals elsewhere, against one merge at a time."""
    rng = random.Random(8)
    for _ in range(60):
        tokens = [b"a", b"b", b"c", *rng.sample([bytes(t) for n in (2, 3, 4) for t in itertools.product(b"abc", repeat=n)], 25)]
        rng.shuffle(tokens)
        ranks = {t: k for k, t in enumerate(tokens)}
        coder = rank_bpe.RankBPE(ranks, r"[\s\S]+")
        texts = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 5, 40, 700]))) for _ in range(12)]
        for text, got in zip(texts, coder.encode(texts), strict=True):
            parts = [text[i : i + 1].encode() for i in range(len(text))]
            while text.encode() not in ranks:
                best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if best == 1 << 40:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            want = [ranks[text.encode()]] if text.encode() in ranks else [ranks[p] for p in parts]
            assert np.frombuffer(got, dtype=np.int32).tolist() == want
            assert coder.encode_long(text.encode()).tolist() == (want if len(want) > 1 else coder.encode_long(text.encode()).tolist())


def test_rank_bpe_of_a_table(docs, library):
    wide = docs.withColumn("decoded", F.lit("clash"))
    got = rank_bpe.encode(wide, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN, batch_chars=200).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in got) == texts
    assert all(r["ids"] == library.encode_ordinary(bytes(r["decoded"]).decode()) for r in got) and got[0]["rank"] == "r"
    assert rank_bpe.encode(docs.limit(0), public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).count() == 0


def test_rank_bpe_slices_long_texts(spark, library, monkeypatch):
    monkeypatch.setattr(rank_bpe, "SLICE", 1000)
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdé\n ") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    coder = rank_bpe.RankBPE(rank_bpe.load_ranks(public_tokenizers.path(queries.RANKS)), public_tokenizers.PATTERN)
    assert np.frombuffer(coder.encode([text])[0], dtype=np.int32).tolist() == library.encode_ordinary(text)


def test_query_of_rank_bpe(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op13_rank_bpe(spark, SF).collect()}
    ids = {k: library.encode_ordinary(t) for k, t in texts.items()}
    assert got == {k: (len(ids[k]), sha(" ".join(map(str, ids[k])).encode()), sha(t.encode())) for k, t in texts.items()}


def test_filter_of_keys(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)
    bits = keyfilter.build(spark.createDataFrame([(int(k),) for k in keys[:10_000]], "key long"))
    assert keyfilter.has(bits, keys[:10_000].view(np.uint64)).all() and keyfilter.has(bits, keys[10_000:].view(np.uint64)).mean() < 0.1
    assert not keyfilter.has(keyfilter.build(spark.createDataFrame([], "key long")), keys.view(np.uint64)).any()
