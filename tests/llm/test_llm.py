"""Each operator against brute force, the tokenizer libraries or held-out labels, and its defined
results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck
from vistaspark.llm import (byte_bpe, chat, components, decontaminate, ngram_join, quality, sharding, token_counts,
                            toxicity, url_filter, wavelet, word_bpe)

SF = "/root/testdata/sf0.01"
QUERIES, SQL = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("key", ["op4_quality_rules", "op6_url_filters", "op8_chat_format"])
def test_query_matches_its_sql(spark, key):
    ok, message, rows = compare(QUERIES[key](spark, SF), duck(SF), SQL[key])
    assert ok and rows, message


def test_every_dealt_operator_and_the_pipeline_are_registered():
    assert "pipeline" in QUERIES
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in QUERIES) == 1


# --- op1, op2, op9: tokenizers ------------------------------------------------------------------

def _tiktoken():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=byte_bpe.load_ranks(byte_bpe.ranks_path()), special_tokens={})


def _check_bpe(rows, source):
    library = _tiktoken()
    expected = Counter()
    for doc_id, text in source:
        ids = library.encode_ordinary(text or "")
        expected[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                 hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows) == expected


def test_byte_bpe_equals_the_library(spark, texts):
    _check_bpe(QUERIES["op1_byte_bpe"](spark, SF).collect(), texts.items())


def test_byte_bpe_odd_rows(odd_docs, no_docs):
    _check_bpe(byte_bpe.digests(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert byte_bpe.digests(no_docs).collect() == []


def test_token_counts_equal_the_library(odd_docs, no_docs, docs):
    library = word_bpe.load(word_bpe.tokenizer_path())
    both = docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    expected = Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids),
                        n > 2048) for r in both.collect())
    found = token_counts.count_tokens(both).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == expected
    assert sum(r.n_shortcut for r in found) > 0 and token_counts.count_tokens(no_docs).collect() == []


def test_proven_words_are_single_tokens():
    library = word_bpe.load(word_bpe.tokenizer_path())
    cut = word_bpe.Words(word_bpe.tokenizer_path(), len, sum).words
    words = [w for w in token_counts.proven_words(word_bpe.tokenizer_path()) if cut(w) == [w]]  # others are never looked up
    assert len(words) > 20_000
    for w in random.Random(1).sample(words, 500):
        assert len(library.encode(w, add_special_tokens=False).ids) == 1


def test_wavelet_matrix_access_rank_select():
    x = np.random.default_rng(1).integers(0, 700, 5000)
    m = wavelet.WaveletMatrix.build(x, 10)
    m = wavelet.WaveletMatrix.from_bytes(m.n, 10, *m.to_bytes(), m.zeros.tolist())
    assert (m.to_array() == x).all()
    assert [m.access(i) for i in (0, 511, 512, 4999)] == x[[0, 511, 512, 4999]].tolist()
    for token in (0, 5, 699, 701):
        at = np.flatnonzero(x == token)
        assert m.rank(token) == len(at) and m.rank(token, 2000) == (at < 2000).sum()
        assert [m.select(token, k) for k in range(len(at) + 1)] == [*at.tolist(), -1]
    assert len(wavelet.WaveletMatrix.build(np.zeros(0, int)).to_array()) == 0


def test_wavelet_files_hold_the_library_ids(spark, texts):
    library = word_bpe.load(word_bpe.tokenizer_path())
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_wavelet_shards"](spark, SF).collect()}
    start, expected = 0, {}
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        expected[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert found == expected


def test_pieces_give_the_library_ids():
    texts = ["", " ", "a\tb\n\nA  b", "<|endoftext|>x <|startoftext|>", "<|x <|endoftext", "e\u0301 \u0301\u00a0z\u2003y",
             "a\x1cb\x85c", "Σς ΑΣ İ ﬁ ＡＢ 中文 👍🏽", "it's 'S we'LL 1234", "long" * 5000, "Straße ÉTÉ été", "\u00e9\n\u0301x"]
    library, words = word_bpe.load(word_bpe.tokenizer_path()), word_bpe.Words(word_bpe.tokenizer_path(), word_bpe.packed_ids, b"".join)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # new tokens, then kept ones
        assert [x.tolist() for x in word_bpe.text_ids(words, pa.array(texts))] == expected
    assert word_bpe.text_ids(words, pa.array([], pa.string())) == []


def test_wavelet_files_odd_rows(spark, odd_docs, no_docs, tmp_path):
    wavelet.write_shards(odd_docs, f"{tmp_path}/odd", tokens_per_shard=50)
    rows = wavelet.document_digests(wavelet.read_shards(spark, f"{tmp_path}/odd")).collect()
    assert len(rows) == odd_docs.count()
    spans = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    wavelet.write_shards(no_docs, f"{tmp_path}/none")
    assert wavelet.document_digests(wavelet.read_shards(spark, f"{tmp_path}/none")).collect() == []


# --- op3: sharding ------------------------------------------------------------------------------

def _check_shards(rows, source, tolerance):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in source)
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes[s] for s in range(8)) <= tolerance


def test_shards_are_near_equal(spark, texts):
    _check_shards(QUERIES["op3_sharding"](spark, SF).collect(), texts.items(), 2 * max(map(len, texts.values())))


def test_shards_split_a_hot_text(spark):
    source = [(i, "same text" if i % 2 else f"text {i}") for i in range(4000)]
    _check_shards(sharding.shard(spark.createDataFrame(source, "doc_id long, text string")).collect(), source, 200)


def test_shards_odd_rows(odd_docs, no_docs):
    _check_shards(sharding.shard(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()], 10**6)
    assert sharding.shard(no_docs).collect() == []


# --- op4, op5: filters --------------------------------------------------------------------------

def test_quality_keeps_clean_and_rejects_symbols(spark, odd_docs, no_docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_quality_rules"](spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept == bool(labels[r.doc_id]) for r in rows)
    assert len(quality.judge(odd_docs.select("doc_id", "text", "lang", "source")).collect()) == odd_docs.count()
    assert quality.judge(no_docs.select("doc_id", "text", "lang", "source")).collect() == []
    assert quality.keep_good(odd_docs).columns == odd_docs.columns


def test_toxicity_on_held_out_labels(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op5_toxicity"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert sum(p for a, p in held if a) >= 0.6 * sum(a for a, _ in held)


def test_toxicity_odd_rows_and_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(3, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and {r.predicted for r in rows} == {0}
    assert toxicity.score(no_docs, none).collect() == []


# --- op6: urls ----------------------------------------------------------------------------------

def test_digest_collisions_are_confirmed(tmp_path):
    entries = [(f"host{i}/", str(i)) for i in range(50)]
    url_filter.DigestArray.write(f"{tmp_path}/x", entries, digest=lambda raw: len(raw))  # nearly all collide
    array = url_filter.DigestArray(f"{tmp_path}/x", digest=lambda raw: len(raw))
    assert array.probe([e[0] for e in entries]) == [e[1] for e in entries]
    assert array.probe(["host99/", "", "other"]) == [None] * 3


def test_urls_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y", "https://example.com/en/", "https://a.net/fr/#z",
            "x://net", "http://com/", "http://notcom/", "http://b.example.com?/en/", "http://" + "a." * 500 + "com/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert [found[i] for i in range(len(urls))] == [
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("www.example.com/en/", "allow"),
        ("example.com/en/", "block"), ("net/fr/", "block"), (None, "allow"), ("com/", "allow"), (None, "allow"),
        (None, "allow"), ("com/", "allow")]
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


def test_every_picked_stem_votes(spark):
    texts = [f"{a}{b}stem" for a in "abcdefghijklmnopqrstuvwxyzéö" for b in "ae"]
    stems = sorted(toxicity.Stem(t, repeated) for t in texts for repeated in (False, True))
    voters = toxicity.Voters(stems)
    assert voters.stems == stems and voters.votes == len(stems) + len(toxicity.PATTERNS)
    docs = spark.createDataFrame([(n, n, f"{t}s {t}ed") for n, t in enumerate(texts)], "doc_id long, rid long, text string")
    for r in toxicity.vote(docs, stems).collect():
        votes = toxicity._unpack(np.array([r.pattern]), voters.bits)[0]
        assert [s for s, v in zip(stems, votes) if v] == [toxicity.Stem(texts[r.doc_id], x) for x in (False, True)]


# --- op7, op10: copies --------------------------------------------------------------------------

def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_decontamination_equals_brute_force(spark, texts):
    items = {r.item_id: [w.lower() for w in _words(r.text)] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    grams = lambda w: [tuple(w[k: k + 5]) for k in range(len(w) - 4)]
    holders = defaultdict(set)
    for i, w in items.items():
        for g in grams(w):
            holders[g].add(i)
    expected = {}
    for d, text in texts.items():
        w = [x.lower() for x in _words(text)]
        own = grams(w)
        for i in set().union(*(holders.get(g, set()) for g in own)):
            item, length = Counter(grams(items[i])), len(items[i])
            best = 0.0
            for start in range(max(1, len(w) - length + 1)):
                window = Counter(own[start: start + length - 4])
                shared = (window & item).total()
                best = max(best, shared / (window.total() + item.total() - shared))
            if best >= 0.75:
                expected[d, i] = round(best, 9)
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in QUERIES["op7_decontamination"](spark, SF).collect()}
    assert found == expected and found


def _best_windows(texts, items):
    """(text's key, item's key) -> best similarity over every window, if at least 0.75."""
    grams = lambda w: [tuple(w[k: k + 5]) for k in range(len(w) - 4)]
    found = {}
    for d, text in texts.items():
        own = grams(text.lower().split())
        for i, item in items.items():
            target, length = Counter(grams(item.lower().split())), len(item.split())
            for start in range(max(1, len(own) + 5 - length)) if target.keys() & set(own) else ():
                window = Counter(own[start: start + length - 4])
                shared = (window & target).total()
                score = shared / (window.total() + target.total() - shared)
                if score >= 0.75 and score > found.get((d, i), (0, 0))[0]:
                    found[d, i] = score, start
    return {k: (round(score, 9), start) for k, (score, start) in found.items()}


def test_decontamination_finds_passages_at_the_limit(spark):
    """Passages without some head and tail words, in another order of their halves, and with repeated words."""
    rng = random.Random(7)
    vocabulary = [f"w{n}" for n in range(400)]
    some = lambda n: rng.choices(vocabulary, range(400, 0, -1), k=n)
    items, texts = {}, {}
    for i in range(150):
        item = some(rng.randint(20, 80)) if i % 10 else some(6) * rng.randint(4, 9)
        items[i] = " ".join(item)
        cut = max(1, (len(item) - 4) // 7 - i % 2)
        head = rng.randint(0, cut)
        passage = item[head: len(item) - (cut - head)] if i % 3 else item[len(item) // 2:] + item[:len(item) // 2]
        texts[i] = " ".join(some(rng.randint(0, 40)) + passage + some(rng.randint(0, 40)))
    expected = _best_windows(texts, items)
    assert len(expected) > 120
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, text string")
    found = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start)
             for r in decontaminate.contaminated(frame(texts, "doc_id"), frame(items, "item_id")).collect()}
    assert found == expected


def test_decontamination_long_items(spark):
    """Items of thousands of words, one of them the same five words over and over, cost their hits only."""
    rng = random.Random(11)
    item = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    round_ = [f"r{n}" for n in range(5)] * 400
    docs = [(1, " ".join(["x"] * 50 + item[100:] + ["y"] * 50)), (2, " ".join(item[:2900])), (3, " ".join(["z"] * 9 + round_ * 2))]
    items = [(1, " ".join(item)), (2, " ".join(round_))]
    found = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(1, 1): (pytest.approx(3896 / 4096), 0), (3, 2): (1.0, 9)}


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "three four five six seven eight nine ten"), (2, None), (3, ""), (4, "few words")],
                                  "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd_docs, items).collect()}
    assert found == {(3, 1), (4, 1), (None, 1), (5, 4), (6, 4)}
    assert decontaminate.contaminated(no_docs, items).collect() == []
    assert decontaminate.contaminated(odd_docs, items.limit(0)).collect() == []
    left = decontaminate.without_contaminated(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 7


def test_decontamination_repeated_items(spark, odd_docs):
    text = "three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (2, "few words")], "item_id long, text string")
    rows = decontaminate.contaminated(odd_docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, i) for d in (3, 4, None) for i in (1, 2, None)} | {(5, 2), (6, 2)}
    assert len(rows) == 3 * 4 + 3  # doc_ids 4 and 6 have two rows each


def _brute_components(rows):
    sets = []
    for _, text in rows:
        w = _words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g]}:
            both = len(s & sets[j])
            if 100 * both >= 75 * len(s | sets[j]):
                parent[find(i)] = find(j)
        for g in s:
            holders[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_jaccard_join_equals_brute_force(spark, texts):
    rows = QUERIES["op10_ngram_jaccard_join"](spark, SF).collect()
    assert Counter(tuple(r) for r in rows) == _brute_components(list(texts.items()))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_near_the_threshold(spark, seed):
    """A large family whose members differ by about as much as a link allows, and short texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w[: rng.randrange(90, 121)])))
    rows += [(1000 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))) for i in range(100)]
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == _brute_components(rows)


def test_jaccard_join_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = ngram_join.jaccard_components(odd_docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == _brute_components(rows)
    kept = ngram_join.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([0, 1, 2, 3, 5, 7, 8, None, 9])
    assert ngram_join.jaccard_components(no_docs).collect() == [] and ngram_join.one_of_each_group(no_docs).collect() == []


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        a = rng.integers(0, 2**64, size, dtype=np.uint64)
        drop = int(rng.integers(0, size // 4 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 2**64, int(rng.integers(0, size // 4 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert len(np.intersect1d(ngram_join.signatures(a, 75), ngram_join.signatures(b, 75)))


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (-5, -7), (-7, -9), (-9, -5)]
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, -5: -9, -7: -9, -9: -9}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


# --- op8: chat ----------------------------------------------------------------------------------

def test_escapes_are_reversible():
    rng = random.Random(5)
    for _ in range(2000):
        role, text = ("".join(rng.choice("<|\\\nan im_end>") for _ in range(rng.randrange(12))) for _ in range(2))
        assert list(chat.read_turns(chat.format_turn(role, text)[0])) == [(role, text)]


def test_layouts_become_turns(spark):
    records = ['{"prompt": "p", "completion": "c"}', '{"instruction": "i", "input": "x", "output": "o"}',
               '{"messages": [{"role": "user", "content": "m"}, {"role": "assistant", "content": null}]}',
               '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', '{"other": 1}', "broken", None]
    rows = chat.turns_of_json(spark.createDataFrame(list(enumerate(records)), "id long, json string"), "id", "json").collect()
    assert sorted((r.conv_id, r.turn or 0, r.role or "", r.text or "") for r in rows) == [
        (0, 0, "user", "p"), (0, 1, "assistant", "c"), (1, 0, "user", "i\n\nx"), (1, 1, "assistant", "o"),
        (2, 0, "user", "m"), (2, 1, "assistant", ""), (3, 0, "user", "h"), (3, 1, "assistant", "g"),
        (4, 0, "", ""), (5, 0, "", ""), (6, 0, "", "")]


def test_conversations_odd_rows(spark):
    rows = [(None, 1, None, None), (1, None, "user", "x"), (1, 0, "assistant", "y" * 600_000), (1, 0, "assistant", "y" * 600_000)]
    turns = chat.turns_of_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(turns)).collect()}
    assert found[1].n_turns == 3 and found[1].loss_chars == 1_200_000
    assert found[1].loss_sha256 == hashlib.sha256(b"y" * 1_200_000).hexdigest()
    assert found[None].n_turns == 1 and found[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert chat.conversation_digests(chat.format_conversations(turns.limit(0))).collect() == []


# --- pipeline -----------------------------------------------------------------------------------

def test_pipeline_applies_its_stages(spark, docs, texts):
    import corpus_pipeline

    toxic = {r.doc_id for r in QUERIES["op5_toxicity"](spark, SF).collect() if r.predicted}
    good = {r.doc_id for r in QUERIES["op4_quality_rules"](spark, SF).collect() if r.kept}
    clean = corpus_pipeline.toxicity(spark, docs, SF)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == texts.keys() - toxic
    rows = corpus_pipeline.run(spark, SF).collect()
    left = {r.doc_id for r in rows}
    assert left <= texts.keys() - toxic and len(left - good) <= 0.01 * len(good)
    _check_bpe(rows, [(d, texts[d]) for d in left])
    leaks = {r.doc_id for r in QUERIES["op7_decontamination"](spark, SF).collect()}
    assert not left & leaks
    assert len({r.component_id for r in ngram_join.jaccard_components(docs.where(docs.doc_id.isin(list(left)))).collect()}) == len(left)
