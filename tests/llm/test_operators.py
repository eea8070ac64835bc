import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import compare
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tessella.llm import _minhash, chat, components, decontaminate, license_scan, minhash_dedup, pack, quality, queries, simhash, substring_dedup, token_count, url_filter

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i}" for i in range(20000))
#: Nulls everywhere, empty and long texts, repeated rows and ids, and a column named like results.
ODD = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG + " tail"), (None, "a b c"), (None, None), (7, "é 中文 x"), (7, "other words here now"), (8, "a b c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("mine"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, small, name):
    compare.agree(spark, queries.QUERIES[name], queries.SQL[name], small)


def texts_of(seed, n=60, vocabulary=30, length=40):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        words = [f"v{int(rng.random() ** 2 * vocabulary)}" for _ in range(rng.randrange(length))]
        if made and rng.random() < 0.5:
            base = rng.choice(made).split()
            cut = rng.randrange(len(base) + 1)
            words = base[cut:] + words[: rng.randrange(4)] if rng.random() < 0.5 else base[:cut] + words[:6] + base[cut:]
        made.append(rng.choice([" ", "  ", "\n"]).join(words))
    return made


# --- near duplicates -------------------------------------------------------------------------


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def linked_groups(rows, k, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    group = {i: i for i in ids}

    def find(i):
        return i if group[i] == i else find(group[i])

    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                group[hi] = lo
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed, blocks", [(1, 1 << 20), (2, 40)])
def test_near_duplicates_are_all_links(spark, monkeypatch, seed, blocks):
    monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", blocks)
    monkeypatch.setattr(minhash_dedup, "SHARE_BYTES", blocks * 8)
    rows = list(enumerate(texts_of(seed, n=120)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), gram=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == linked_groups(rows, 2, 80)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, 2)) for i, t in rows}


def test_near_duplicates_odd(odd, none):
    got = minhash_dedup.near_duplicates(odd, gram=4).collect()
    want = linked_groups(ODD, 4, 80)
    assert len(got) == len(ODD)
    assert all(r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert minhash_dedup.near_duplicates(none).count() == 0
    kept = minhash_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 7}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    a, b = np.sort(x[:200]), np.sort(x[50:250])
    s = _minhash.signatures(np.concatenate([a, b, a[:1]]), np.array([0, 200, 400, 401, 401]))
    assert abs((s[0] == s[1]).mean() - 150 / 250) < 0.15
    assert (s[2] == a[0]).all() and (s[3] == 0).all()


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (None, 3)]
    group = {i: i for e in edges if None not in e and e[0] != e[1] for i in e}

    def find(i):
        return i if group[i] == i else find(group[i])

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            group[hi] = lo
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {i: find(i) for i in group} and len(got) == len(group)


# --- packing and tokens ----------------------------------------------------------------------

TRICKY = ["", " ", "a", "It's 12 o'clock, they'll go!", "x<|endoftext|>y <|endoftext|>", "中文 é́ 🙂👍🏽", "\n\n  \t a  b ", "a" * 3000, " " * 5000 + "x", "  ​z", "1234567890" * 20, "end\n"]


def library_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_token_counts_are_the_library_s(spark, odd, none):
    ids = library_ids()
    rows = list(enumerate([*TRICKY, *(t for _, t in ODD)]))
    got = token_count.count_tokens(spark.createDataFrame(rows, "i int, text string"), BPE, carry=["i"]).collect()
    assert {r["i"]: r["n_tokens"] for r in got} == {i: len(ids(t)) for i, t in rows}
    assert token_count.count_tokens(odd, BPE).columns == ["doc_id", "text", "score", "n_tokens"]
    assert token_count.count_tokens(none, BPE).count() == 0
    with pytest.raises(ValueError):
        token_count.count_tokens(odd, BPE, as_col="score")


def test_token_counts_small_memory_and_pieces(spark):
    ids = library_ids()
    count = token_count.counter(BPE, memory=2)
    assert [count(t) for t in TRICKY] == [len(ids(t)) for t in TRICKY]
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_count.count_tokens(spark.createDataFrame([(t,) for t in TRICKY], "text string"), path).collect()
    assert all(r["n_tokens"] == len(model.encode(r["text"])) for r in got)


def test_packing_is_an_exact_round_trip(spark, odd, none):
    ids = library_ids()
    rows = list(enumerate([*TRICKY, *(t for _, t in ODD)]))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    pieces = pack.pack(docs, BPE, length=64)
    got = pieces.collect()
    held = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        part = held.setdefault(r["doc_id"], [])
        assert r["start"] == len(part) and len(r["ids"]) == 4 * r["length"]
        part += np.frombuffer(r["ids"], "<u4").tolist()
    assert held == {i: [*ids(t), 0] for i, t in rows}
    place = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = 0
    for sequence, offset, length in place:
        assert sequence * 64 + offset == at and offset + length <= 64
        at += length
    whole = pack.sequences(pieces, length=64).collect()
    assert sum(r["n_tokens"] for r in whole) == at and all(len(r["ids"]) == 256 for r in whole)
    assert pack.pack(none, BPE).count() == 0
    assert pack.pack(odd, BPE).columns[:2] == ["doc_id", "score"]


def test_packing_query_digests(spark, small):
    ids = library_ids()
    docs = {r["doc_id"]: np.array([*ids(r["text"]), 0], "<u4") for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in pack.op2(spark, small).collect():
        own = docs[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())


# --- decontamination -------------------------------------------------------------------------


def brute_hits(text, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        k = min(window, len(w))
        for s in {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else ():
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) == s:
                    hit.update(range(i, i + k))
                    found.add(item)
    return len(words), len(hit), sorted(x for x in found if x is not None)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_is_exact(spark, block_bytes):
    docs = [*enumerate(texts_of(5, n=40)), (None, "V1, v2! (v3)"), (99, None), (98, "")]
    items = [(i, " ".join(t.split()[:n])) for i, (t, n) in enumerate(zip(texts_of(5, n=40)[::3], [3, 30, 9, 8, 1, 0, 12] * 2))] + [(2, "v1 v2 v3"), (None, "v4 v5"), (77, None)]
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=6, gram=3, block_bytes=block_bytes)
    got = sorted(((r["text"] or "", r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()), key=str)
    assert got == sorted(((t or "", *brute_hits(t, items, 6)) for _, t in docs), key=str)
    assert all(sum(s["length"] for s in r["hit_spans"]) == r["n_hit"] for r in found.collect())


def test_decontamination_odd(spark, odd, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.decontaminate(odd, items).collect()} == {0}
    assert decontaminate.decontaminate(none, items).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(odd.withColumnRenamed("score", "n_hit"), items)


# --- SimHash ---------------------------------------------------------------------------------


def test_edited_texts(spark, monkeypatch):
    monkeypatch.setitem(simhash.in_order.__kwdefaults__, "range_bytes", 50)
    rows = [(i * 7 % 41, t) for i, t in enumerate([*texts_of(3, n=36), "🙂é中", None, "", "one"])]
    got = {r["doc_id"]: r for r in simhash.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for (i, t), (j, after) in zip(order, order[1:] + order[:1]):
        n = len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        want = simhash.fingerprints(pa.array([t, edited, after]))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (want[0].tobytes().hex(), want[1].tobytes().hex())
        assert r["near_next"] == pytest.approx(simhash.likeness(want[:1], want[2:])[0])


def test_edited_texts_odd(spark, odd, none):
    got = simhash.edit_likeness(odd).collect()
    assert len(got) == len(ODD)
    same = [r for r in got if r["doc_id"] == 1]
    assert same[0]["fingerprint"] == same[1]["fingerprint"]
    assert simhash.edit_likeness(none).count() == 0
    lone = simhash.edit_likeness(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert lone["near_next"] == 1.0


def test_votes_are_signs():
    from tessella.llm._words import SPACED, Words, mix

    text = " ".join(f"w{i % 400}" for i in range(1000))
    h, _ = simhash._terms(Words(pa.array([text], pa.large_string()), SPACED), 3)
    bits = np.stack([np.unpackbits(mix(h + np.uint64(0xA0761D6478BD642F * (k + 1) & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8), axis=1) for k in range(2)], 1).reshape(len(h), 128)
    assert (np.unpackbits(simhash.fingerprints(pa.array([text]))[0]) == (2 * bits.sum(0) > len(h))).all()


@pytest.mark.parametrize("radius, blocks", [(5, None), (3, 4), (20, 21)])
def test_search_within_radius_is_complete(spark, radius, blocks):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (12, 16), dtype=np.uint8)
    made = [b ^ np.packbits(np.isin(np.arange(128), rng.choice(128, k, replace=False))) for b in base for k in range(7)]
    rows = [(i, p.tobytes()) for i, p in enumerate([*made, made[0]])] + [(999, None)]
    frame = spark.createDataFrame(rows, "doc_id long, fingerprint binary")
    pairs, members = simhash.near_fingerprints(frame, id_col="doc_id", radius=radius, blocks=blocks)
    got = [(bytes(r[0]), bytes(r[1]), r[2]) for r in pairs.collect()]
    distinct = sorted({p.tobytes() for p in made})
    apart = lambda a, b: int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())
    assert sorted(got) == [(a, b, apart(a, b)) for a in distinct for b in distinct if a < b and apart(a, b) <= radius]
    assert members.count() == len(rows) - 1
    counts = {bytes(r["print"]): (r["rows"], r["classes"]) for r in simhash.count_near(frame.where("doc_id % 3 = 0"), frame, radius=radius, blocks=blocks).collect()}
    held = [p for _, p in rows if p]
    assert counts == {p: (sum(apart(p, x) <= radius for x in held), sum(apart(p, x) <= radius for x in distinct)) for i, p in rows if i % 3 == 0 and p}
    assert simhash.near_fingerprints(frame.limit(0), id_col="doc_id")[0].count() == simhash.count_near(frame, frame.limit(0)).count() == 0


def test_fingerprint_query_counts_all_documents_within_the_radius(spark, small):
    got = simhash.op5(spark, small).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = dict(zip(ids, simhash.fingerprints(pa.array([texts[i] for i in ids], pa.large_string()))))
    assert sorted(r["doc_id"] for r in got) == ids
    for r in got:
        after = texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        own, n = texts[r["doc_id"]], len(texts[r["doc_id"]])
        edited = own[: n - n // 4] + after[: n // 4]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["fingerprint"] == prints[r["doc_id"]].tobytes().hex()
        a, b = simhash.fingerprints(pa.array([own, edited], pa.large_string()))
        assert r["near_edited"] == pytest.approx(max(0, np.cos(np.pi * np.bitwise_count(a ^ b).sum() / 128)))
        near = [x for x in prints.values() if np.bitwise_count(x ^ prints[r["doc_id"]]).sum() <= 3]
        want = (len(near) - 1, len({x.tobytes() for x in near})) if r["doc_id"] % 100 == 0 else (None, None)
        assert (r["n_within"], r["n_classes"]) == want


# --- substring deduplication -----------------------------------------------------------------


def brute_cut(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - window + 1 if i is not None else 0):
            s = tuple(w[p : p + window])
            first[s] = min(first.get(s, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = {q for p in range(len(w) - window + 1 if i is not None else 0) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, window", [(1, 5), (2, 2), (3, 13)])
def test_substrings(spark, monkeypatch, seed, window):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 300)
    monkeypatch.setattr(substring_dedup, "SORT_BYTES", 500)
    rows = [(i * 37 % 101, t) for i, t in enumerate(texts_of(seed, n=90, length=60))] + [(None, "v1 v2 v3 v4 v5 v6"), (200, None), (3, texts_of(seed)[5])]
    found = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window=window, layout="words").collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found), key=str) == brute_cut(rows, window)
    for r in found:
        assert sum(f["length"] for f in r["factors"]) == r["n_removed"] and all(f["source"] < r["doc_id"] for f in r["factors"])
    # Every factor is a copy of the words at its offset in its source (the id that two rows share is left out).
    words = {i: (t or "").split() for i, t in rows}
    for r in found:
        for f in r["factors"]:
            if 3 not in (r["doc_id"], f["source"]):
                assert words[r["doc_id"]][f["start"] : f["start"] + f["length"]] == words[f["source"]][f["offset"] : f["offset"] + f["length"]]


def test_substrings_keep_white_space_and_odd_rows(spark, odd, none):
    rows = [(1, "a b c d e"), (2, "x\n a b  c\td e  y")]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window=4)
    assert {r["doc_id"]: r["kept_text"] for r in got.collect()} == {1: "a b c d e", 2: "x\n y"}
    found = substring_dedup.dedup_substrings(odd)
    assert found.columns == ["doc_id", "score", "n_words", "n_removed", "kept_text", "factors"] and found.count() == len(ODD)
    assert {r["doc_id"]: r["kept_text"] for r in found.collect()}[6] == "tail"
    assert substring_dedup.dedup_substrings(none).count() == 0


# --- chat ------------------------------------------------------------------------------------


def test_chat_perspectives(spark):
    turns = [(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "bye"), (1, None, None, "x"), (2, 0, "system", "alone"), (None, 0, "ann", "n"), (None, 0, "ann", "n")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("clash"))
    rendered = chat.rotate(frame)
    got = {(r["conv_id"], r["perspective"]): r for r in chat.dialogues(rendered).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "ann")}
    text = got[1, "ann"]["text"]
    assert text == "<|system|>\nbe<|end|>\n<|assistant|>\nhi<|end|>\n<|user:bob|>\n<|end|>\n<|assistant|>\nbye<|end|>\n<|user:|>\nx<|end|>\n"
    assert [text[m["start"] : m["stop"]] for m in got[1, "ann"]["mask"]] == ["hi<|end|>", "bye<|end|>"]
    assert got[None, "ann"]["text"] == "<|assistant|>\nn<|end|>\n" * 2
    assert chat.rotate(frame.limit(0)).count() == 0


def test_turns_without_numbers(spark):
    rng = random.Random(2)
    rows = [(1, rng.choice([None, None, 7, 900]), rng.choice([None, "ann", "bob"]), rng.choice(["", "aaa", "aaab", "é", "中文"]) + rng.choice(["", "x", "y"])) for _ in range(120)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = sorted(rows, key=lambda r: ((r[1] is None, r[1] or 0), (r[2] is None, r[2] or ""), r[3].encode()))
    for who in ("ann", "bob"):
        mine = sorted((r for r in got if r["perspective"] == who), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(120)) and all(a["stop"] == b["start"] for a, b in zip(mine, mine[1:]))
        assert [(r["turn"], r["segment"].split("|>\n", 1)[1]) for r in mine] == [(t, x + "<|end|>\n") for _, t, _, x in want]


# --- urls ------------------------------------------------------------------------------------


def test_urls(spark):
    page = lambda i, url, *links: (i, url, "".join(f'<p><a class="x" href="{x}">y</a>' for x in links))
    rows = [
        page(1, "http://A.Example.com/en/1", "/x", "https://spam.org/y"), page(2, "https://www.example.com/en/x?q#z"), page(3, "http://x.net/es/1"), page(4, "http://x.net/es/2"), page(5, "http://x.net/de/2"),
        page(6, "http://friend.org/1", "//x.net/"), page(7, "http://clean.org/2", "http://www.example.com/"), (8, None, None), (9, "no scheme", ""), page(10, "http://com?x=://y/"), (10, "http://notexample.com/en/", None),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = sorted(tuple(r)[:5] for r in url_filter.filter_urls(frame, url_filter.RULES).collect())
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("x.net", "/es/1", "net/es/", "block"), ("x.net", "/es/2", "net/es/", "block"), ("x.net", "/de/2", None, "block"),
        ("friend.org", "/1", None, "block"), ("clean.org", "/2", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "", None, "allow"), ("notexample.com", "/en/", "com/", "allow"),
    ]
    assert url_filter.filter_urls(frame.limit(0), url_filter.RULES).count() == 0


def host_verdicts(spark, links, others=0):
    """Verdicts of hosts with one page each; those that start with "bad" are blocked by the rule. ``others`` hosts stand alone."""
    rows = [(i, f"http://{h}.org/{'bad' if h.startswith('bad') else 'x'}", "".join(f'<a href="http://{x}.org/">y</a>' for x in to)) for i, (h, to) in enumerate(links.items())]
    alone = spark.range(others).select((F.col("id") + len(rows)).alias("page_id"), F.format_string("http://alone%d.org/x", "id").alias("url"), F.lit("").alias("html"))
    found = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string").union(alone), [("org", "/bad", "block")])
    return {r["host"].split(".")[0]: r["verdict"] for r in found.where(F.col("page_id") < len(rows)).collect()}


def test_isolated_hosts_change_no_verdict(spark):
    links = {"c": ["a"], "a": ["bad"], "bad": []}
    assert host_verdicts(spark, links, others=20000) == host_verdicts(spark, links)


def test_linkers_of_blocked_hosts_are_judged_by_their_own_links(spark):
    links = {f"a{i}": ["bad"] for i in range(30)} | {"bad": ["clean"], "c": ["d"], "d": ["bad1", "bad2", "bad3"], "bad1": [], "bad2": [], "bad3": []}
    links |= {"much": ["bad1", "bad2", "clean"], "little": ["bad1", "clean", "e1", "e2"], "clean": ["e1"]}
    got = host_verdicts(spark, links)
    assert {h for h, v in got.items() if v == "block"} == {h for h in links if h[0] == "a" or h.startswith("bad") or h in ("c", "d", "much")}


def test_shares_are_the_fixed_point(spark):
    rng = random.Random(5)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(a, b): rng.randrange(1, 5) for a in hosts[:9] for b in hosts if a != b and rng.random() < 0.25}
    seeds = {h: (rng.random(), rng.random()) for h in hosts[:6]}
    frames = spark.createDataFrame([(*k, v) for k, v in edges.items()], "src string, dst string, links long"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(*frames, shares=True).collect()}
    for kind in (0, 1):
        want = {h: seeds.get(h, (0, 0))[kind] for h in got}
        for _ in range(200):
            mean = lambda h: (sum(n * want[e[kind]] for e, n in edges.items() if e[1 - kind] == h), sum(n for e, n in edges.items() if e[1 - kind] == h))
            want = {h: max(seeds.get(h, (0, 0))[kind], 0.85 * m / n if n else 0) for h in got for m, n in [mean(h)]}
        assert {h: s[kind] for h, s in got.items()} == pytest.approx(want, abs=1e-3)


def test_propagation_is_the_fixed_point(spark):
    rng = random.Random(4)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(a, b): rng.randrange(1, 5) for a in hosts[:9] for b in hosts if a != b and rng.random() < 0.25}
    seeds = {h: (rng.random(), rng.random()) for h in hosts[:6]}
    scores = url_filter.propagate(spark.createDataFrame([(*k, v) for k, v in edges.items()], "src string, dst string, links long"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), tolerance=1e-10, rounds=200)
    got = {r["host"]: (r["trust"], r["distrust"]) for r in scores.collect()}
    for kind in (0, 1):
        m = np.zeros((12, 12))
        for (a, b), n in edges.items():
            i, j = (hosts.index(a), hosts.index(b)) if kind == 0 else (hosts.index(b), hosts.index(a))
            m[j, i] = n
        out = m.sum(0)
        m = m / np.where(out, out, 1) + np.diag(out == 0)
        s = np.array([seeds.get(h, (0, 0))[kind] for h in hosts])
        want = np.linalg.solve(np.eye(12) - 0.85 * m, 0.15 * s)
        for h, w in zip(hosts, want):
            if h in got:
                assert got[h][kind] == pytest.approx(w, abs=1e-6)


# --- licences --------------------------------------------------------------------------------


def test_licences(spark, odd, none):
    texts = [
        "Released under the MIT License.", "see mit-license and MIT LICENSE and the GNU General Public License", "x Licensed under CC BY-NC 4.0.\nok", "cc by", "permission slips are hereby granted",
        "/* Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files */", "licensed under by cc nc", "mit licenses", None, "",
        "Licensed under the Apache License, Version 2.0 " * 3,
    ]
    rows = list(enumerate(texts))
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    base = [[(p["label"], p["start"]) for p in r["places"]] for r in got]
    assert base[0] == [("mit", 3)] and base[1] == [("mit", 1), ("mit", 4), ("gpl", 9)] and base[10] == [("apache", 3), ("apache", 11), ("apache", 19)]
    quoted = [sorted({q["label"] for q in r["quotes"]}) for r in got]
    assert [quoted[i] for i in (0, 2, 5, 10)] == [["mit"], ["cc-by-nc"], ["mit"], ["apache"]]
    assert not any(quoted[i] for i in (3, 4, 6, 7, 8, 9))
    assert got[0]["likeness"] == 1.0 and got[2]["likeness"] == 1.0 and got[8]["n_words"] == 0 and got[8]["likeness"] == 0.0
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(none).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(odd.withColumnRenamed("score", "places"))


def test_licences_whose_key_phrase_comes_first(spark):
    titles = ["GNU Affero General Public License Version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1", "see CC BY-NC 4.0", "MIT License", "BY-NC 4.0"]
    rows = list(enumerate([*titles, *("one two three four five six seven eight " + t for t in titles), *["released licensed under the terms of"] * 20]))
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    labels = [sorted({q["label"] for q in r["quotes"]}) for r in got]
    assert labels[:5] == labels[5:10] == [["agpl"], ["lgpl"], ["cc-by-nc"], ["mit"], []]
    assert [[q["start"] for q in r["quotes"]] for r in got[:4]] == [[-5], [-5], [-1], [-3]]
    assert [r["likeness"] for r in got[:5]] == [r["likeness"] for r in got[5:10]]


def test_licences_named_by_their_key_phrase_alone(spark, tmp_path):
    """Whatever is rare in the corpus, each template is quoted just where its key phrase stands."""
    known, rng = license_scan.LICENCES, random.Random(9)
    texts = ["", *(f"one two {key} three" for _, _, key in known), *(key for _, _, key in known)]
    for _, template, _ in known:  # passages with the ends, or words between, missing or changed
        w = template.split()
        texts += [" ".join(["x"] * rng.randrange(4) + w[rng.randrange(len(w)) :]), " ".join(w[: rng.randrange(len(w)) + 1]), " ".join(v if rng.random() < 0.8 else "x" for v in w)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def places(text):
        w = text.split()
        for t, (label, template, key) in enumerate(known):
            k, v = key.split(), template.split()
            at = next(i for i in range(len(v)) if v[i : i + len(k)] == k)
            yield from ((label, t, i - at) for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k)

    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, text in enumerate(texts):
        assert sorted((q["label"], q["template"], q["start"]) for q in got[i]["quotes"]) == sorted(places(text)), text
        assert got[i]["likeness"] >= max((q["share"] for q in got[i]["quotes"]), default=0)

    titles = {1: ("Mozilla Public License Version 2.0", "mpl"), 2: ("as in the GNU Lesser General Public License", "lgpl"), 3: ("GNU General Public License", "gpl"), 4: ("the public license of mozilla", "")}
    rows = [(i, text) for i, (text, _) in titles.items()] + [(i, "public license gnu general the work") for i in range(5, 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = {r["doc_id"]: r["labels"] for r in license_scan.op9(spark, str(tmp_path)).collect()}
    assert {i: labels[i] for i in titles} == {1: "mpl", 2: "gpl,lgpl", 3: "gpl", 4: ""}


# --- quality ---------------------------------------------------------------------------------


def test_quality_generalises(spark, small):
    scored = quality.op10(spark, small).toPandas()
    labels = spark.read.parquet(f"{small}/labels.parquet").toPandas().merge(scored, on="doc_id")
    held = labels[labels.held_out]
    assert len(scored) == spark.read.parquet(f"{small}/documents.parquet").count() and len(held) > 15
    assert (held.quality == held.predicted).mean() >= 0.9
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(scored.doc_id, scored.held_out))


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    got = quality.score(odd, model, as_col="p").collect()
    assert len(got) == len(ODD) and all(0 <= r["p"] <= 1 for r in got)
    assert quality.score(none, model).count() == 0
    constant = quality.train(odd, labels.where("quality = 1"))
    assert {r["p"] for r in quality.score(odd, constant, as_col="p").collect()} == {0.75}
    with pytest.raises(ValueError):
        quality.score(odd, model)


def test_training_takes_whole_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Attention, "fit", lambda self, x, first, y: seen.append((np.diff(first).tolist(), x)) or self)
    texts = ["a b", LONG, "c " * 130, "d"]
    docs, labels = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    quality.train(docs, labels)
    x, first = quality.encode(pa.array(texts, pa.large_string()))
    assert seen[0][0] == np.diff(first).tolist() == [1, 313, 3, 1] and (seen[0][1] == x.astype(np.float16)).all()
    quality.train(docs, labels, passages=312)
    assert seen[1][0] == [1, 3, 1]


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, first, y = rng.standard_normal((9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.Attention().fit(x.astype(np.float32), first, y, epochs=2)
    model.w = [np.asarray(w, np.float64) for w in model.w]
    loss = lambda: -np.mean(y * np.log(model._forward(x, first)[5]) + (1 - y) * np.log(1 - model._forward(x, first)[5]))
    for i, g in enumerate(model._gradients(x, first, y)):
        flat = model.w[i].reshape(-1) if model.w[i].ndim else None
        at = 0
        before = model.w[i].copy()
        ends = []
        for e in (1e-5, -1e-5):
            model.w[i] = before.copy()
            if flat is None:
                model.w[i] = before + e
            else:
                model.w[i].reshape(-1)[at] += e
            ends.append(loss())
        model.w[i] = before
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(float(np.reshape(g, -1)[at]), abs=1e-4)
    assert model.weights(x, first)[:2].sum() == pytest.approx(1)


def test_passages_of_texts():
    x, first = quality.encode(pa.array(["", "a " * 130, None, "\n"], pa.string()).fill_null("").cast(pa.large_string()))
    assert np.diff(first).tolist() == [1, 3, 1, 1] and not x[0, :256].any() and x[1, 257] == 1.0


# --- names, ties and long inputs -------------------------------------------------------------

TAKEN = ["_text", "_id", "_own", "_n", "_part", "_ids", "_gone", "_items", "_spans", "_bucket", "_key", "aligned", "checked", "words", "row", "near", "part", "h", "a.b", "tick`"]


def test_columns_of_any_name_come_through(spark):
    rows = [(1, "Released under the MIT License one two three four five"), (2, "a b c d e f g h"), (3, "a b c d e f g h"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in TAKEN))
    items = spark.createDataFrame([(7, "b c d e f g h a")], "item_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    made = {
        "count": token_count.count_tokens(docs, BPE), "pack": pack.pack(docs, BPE), "clean": decontaminate.decontaminate(docs, items), "print": simhash.fingerprint(docs),
        "cut": substring_dedup.dedup_substrings(docs), "licence": license_scan.scan(docs), "score": quality.score(docs, model), "dedup": minhash_dedup.drop_near_duplicates(docs),
    }
    for name, table in made.items():
        got = table.collect()
        assert {r["doc_id"] for r in got} == ({1, 2, 4} if name == "dedup" else {1, 2, 3, 4}), name
        assert all(r[c] == f"{c} {r['doc_id']}" for r in got for c in TAKEN), name
    for result, call in [("n_tokens", lambda d: token_count.count_tokens(d, BPE)), ("ids", lambda d: pack.pack(d, BPE)), ("hit_spans", lambda d: decontaminate.decontaminate(d, items)), ("FACTORS", substring_dedup.dedup_substrings), ("quotes", license_scan.scan)]:
        with pytest.raises(ValueError):
            call(docs.withColumn(result, F.lit(1)))


def test_url_sql_walks_links_too(spark, tmp_path):
    import duckdb

    links = {"c": ["a"], "a": ["bad"], "bad": [], "d": ["c", "good"], "good": ["d"], "e": ["bad", "bad2", "good"], "bad2": ["e"], "f": ["f", "g"]}
    rows = [(i, f"http://{h}.net/{'es/' if h.startswith('bad') else 'x'}", "".join(f'<a href="https://{x}.net/">y</a>' for x in to)) for i, (h, to) in enumerate(links.items())]
    rows += [(90, None, None), (91, "no scheme", '<a href="//bad.net">'), (92, "x://good.net/fr", "<a href=//com/>z"), (93, "http://www.Example.com/en/", ""), (93, "http://www.Example.com/en/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in url_filter.op7(spark, str(tmp_path)).collect()), key=str)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.OP7_SQL})").fetchall()
    assert got == sorted(want, key=str)
    assert {r[1] for r in got if r[4] == "block" and r[3] is None} == {"a.net", "c.net", "e.net"}


def test_many_rules(spark):
    rules = [(f"h{i}.org", "/a/", "block") for i in range(5000)] + [("h7.org", "/a/b/", "allow"), ("h8.org", "/a/", "allow")]
    name, verdict = url_filter.match(F.col("h"), F.col("p"), rules)
    asked = [("h7.org", "/a/b/c"), ("x.h7.org", "/a/c"), ("h8.org", "/a/"), ("xh9.org", "/a/"), ("", ""), (".h9.org", "/a/"), ("org", "/a/")]
    got = [tuple(r) for r in spark.createDataFrame(asked, "h string, p string").select(name, verdict).collect()]
    assert got == [("h7.org/a/b/", "allow"), ("h7.org/a/", "block"), ("h8.org/a/", "block"), (None, None), (None, None), ("h9.org/a/", "block"), (None, None)]
    with pytest.raises(ValueError):
        url_filter.match(F.col("h"), F.col("p"), rules * 11)


def test_equal_ids_and_hot_keys(spark):
    same = [(1, "x y z " * 10), (1, "other words entirely"), *[(None, f"null {i} a b c d") for i in range(50)], *[(2, "x y z " * 10)] * 40]
    docs = spark.createDataFrame(same, "doc_id long, text string")
    assert substring_dedup.dedup_substrings(docs, window=5).where("n_removed > 0").groupBy("doc_id").count().collect() == [(2, 40)]
    got = simhash.edit_likeness(docs).collect()
    assert len(got) == len(same) and sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 2) >= 39
    found = minhash_dedup.near_duplicates(docs).collect()
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2)} == {1} and sum(r["kept"] for r in found) == 2 + 50


def test_counts_query_columns(spark, small):
    ids = library_ids()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = token_count.op3(spark, small).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {i: (len(t.encode()), len(ids(t)), len(ids(t)) > 1024) for i, t in texts.items()}


def test_a_hundred_licences(spark):
    titled = [(i, f"x {t.upper()} y") for i, (_, t, _) in enumerate(license_scan.LICENCES)]
    assert len(titled) > 100
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(titled, "doc_id long, text string")).collect()}
    for i, (label, template, _) in enumerate(license_scan.LICENCES):
        assert label in {q["label"] for q in got[i]["quotes"]} and got[i]["likeness"] == 1.0, template


# --- the fast encoder against the file's library; recall on shared boilerplate ---------------

_pieces = st.one_of(
    st.text(max_size=8),
    st.text("aeiou xyz'0123456789.,\n\t \u00a0\u2003\u3000\u0085\u200b", max_size=20),
    st.sampled_from(["'s", "'LL", "<|endoftext|>", "\r\n", "\u2028", "é", "e\u0301", "中文", "🙂👍🏽", "\x00", "\ufeff", "1" * 9, " " * 7, "a" * 40]),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(_pieces, max_size=12).map("".join))
def test_ids_and_counts_are_the_library_s_on_any_text(text):
    from tessella.llm._bpe import load

    want = library_ids_of()(text)
    assert load(BPE).ids(text).tolist() == want and counted()(text) == len(want)


def library_ids_of(held=[]):
    held or held.append(library_ids())
    return held[0]


def counted(held=[]):
    held or held.append(token_count.counter(BPE))
    return held[0]


def test_near_duplicates_with_shared_boilerplate(spark):
    """Documents that share a long passage, so most buckets hold unlike ones: every link of the exact join is found."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(400):
        own = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 60))]
        if rows and rng.random() < 0.3:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(4)):
                base[rng.randrange(len(base))] = f"e{rng.randrange(99)}"
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(own + common)))
    rng.shuffle(rows)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), gram=4).collect()
    want = linked_groups(sorted(rows), 4, 80)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) < 370


def brute_passages(text):
    """Features of a text's passages, word by word."""
    from collections import Counter

    raw = (text or "").encode()
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    if not at:
        return [[0.0] * (quality.FEATURES - 1) + [1 / quality.PASSAGE]]
    words = [raw[a:b] for a, b in at]
    whole = [len(set(words)) / len(words), max(Counter(words).values()) / len(words)]
    out = []
    for i in range(0, len(words), quality.PASSAGE):
        part = words[i : i + quality.PASSAGE]
        stop = at[i + quality.PASSAGE][0] if i + quality.PASSAGE < len(words) else len(raw)
        held = Counter(raw[at[i][0] : stop])
        size = sum(held.values())
        own = [len(set(part)) / len(part), max(Counter(part).values()) / len(part), sum(map(len, part)) / len(part) / 10]
        out.append([*((held[b] / size) ** 0.5 for b in range(256)), *own, *whole, len(part) / quality.PASSAGE])
    return out


def test_quality_scores_follow_the_formula(spark):
    texts = ["one two two " * 50, " \n  é中文 A,b;" * 9, None, "", " \n", "x", "Good text. " * 40 + "bad " * 90, "1 2 3 4 5"]
    x, first = quality.encode(pa.array([t or "" for t in texts], pa.large_string()))
    brute = [brute_passages(t) for t in texts]
    assert np.diff(first).tolist() == [len(b) for b in brute] and np.allclose(x, np.array([p for b in brute for p in b]), atol=1e-6)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    w, b, gate_v, gate_u, att, out, bias = (np.asarray(p, np.float64) for p in model.w)
    for i, bag in enumerate(brute):
        h = [np.tanh(((np.array(p) - model.mean) * model.scale) @ w + b) for p in bag]
        e = [np.exp((np.tanh(v @ gate_v) / (1 + np.exp(-(v @ gate_u)))) @ att) for v in h]
        z = sum(k * v for k, v in zip(e, h)) / sum(e)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(z @ out + bias))), abs=1e-4)
