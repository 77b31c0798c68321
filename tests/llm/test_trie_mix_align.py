"""Prefix trie, source mix and token alignment against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as E
from datasets import SF_SMALL
from tools.oracle_check import compare, duck
from vistaspark.llm import alignment, mixing, prefix_trie

SF = "/root/testdata/sf0.01"
QUERIES, SQL = E.queries(), E.oracle_sql()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# --- prefix trie --------------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = own.get(base, [])[:h] + mine[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, sequence in whole.items():
        for d in range(len(sequence) + 1):
            members[tuple(sequence[:d])].append(c)
        ends[tuple(sequence)].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    saved, leaves = Counter(), Counter()
    for node in members:
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += not children[node]
    return Counter((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items())


TURNS = "conv_id long, turn long, role string, text string, code long, steps string, shard int, n string"


def trie_of(spark, rows, shard_turns=prefix_trie.SHARD_TURNS):
    table = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], TURNS)
    return Counter(tuple(r[c] for c in NODE) for r in prefix_trie.conversation_trie(table, shard_turns).collect())


@pytest.mark.parametrize("seed,shard_turns", [(1, 1 << 18), (2, 1), (3, 4)])
def test_trie_equals_brute_force(spark, seed, shard_turns):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(700), 120):
        same = draw.random() < 0.4  # a group of copies with a third of the rows
        for t in range(3 if same else draw.randint(1, 9)):
            rows.append((c, t, draw.choice(["user", "assistant"]) if not same else "user", "copy" if same else draw.choice(["a", "bb", "ccc", None, "déjà 漢"])))
    draw.shuffle(rows)
    assert trie_of(spark, rows, shard_turns) == brute_trie(rows)


def test_trie_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (0, None, "user", "null turn comes first"), (0, 0, None, None), (0, 1, "user", "x" * 200_000), (0, 1, "user", "x" * 200_000),
            (7, 0, "", ""), (107, 0, "user", "no base"), (-3, 0, "user", "negative"), (-103, 2, "user", "negative"), (5, 3, None, "")]
    rows += [(300, t, "user", "deep") for t in range(120)] + [(301 + k, t, "user", "deep") for k in range(6) for t in range(110 + k)]
    want = brute_trie(rows)
    assert trie_of(spark, rows, 100) == want
    assert max(n[1] for n in want) >= 120 and min(n[0] for n in want) == -103


def test_trie_of_turnless_conversations_and_of_nothing(spark):
    lonely = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)  # its only turn is replaced by none
    assert trie_of(spark, [(lonely, 0, "user", "gone")]) == Counter(
        [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())])
    assert not trie_of(spark, [])


def test_equal_turns_have_one_defined_order(spark):
    rows = [(0, 1, "user", "b"), (0, 1, "user", "a"), (0, 0, "user", "c")]
    got = trie_of(spark, rows)
    assert got == trie_of(spark, rows[::-1]) and sum(got.values()) == 4


def test_search_tree_is_balanced_by_medians():
    tree = prefix_trie.SearchTree()
    for i in prefix_trie.medians(1023):
        tree.insert([i])
    deep, level = 0, [tree.eq[0]]
    while level:
        deep, level = deep + 1, [c for x in level for c in (tree.lo[x], tree.hi[x]) if c >= 0]
    assert deep == 10 and [tree.key[c] for c in tree.children(0)] == list(range(1023))


# --- source mix -----------------------------------------------------------------------------------


def brute_mix(rows, weights=mixing.WEIGHTS, most=mixing.MAX_EPOCHS):
    """Targets by resharing the excess until none is left over."""
    import re

    size = {i: len(re.findall(mixing.WORD, t or "")) for i, (_, t, _) in enumerate(rows)}
    sources = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    total = {s: sum(size[i] for i, r in enumerate(rows) if r[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    free, left, target = set(sources), sum(total.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > most * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: float(most * total[s]) for s in full}
        left, free = left - sum(most * total[s] for s in full), free - full
    return size, total, target


def check_mix(rows, got):
    size, total, target = brute_mix(rows)
    assert Counter((r.doc_id, r.source, r["size"], r.source_size) for r in got) == Counter((d, s, size[i], total[s]) for i, (d, _, s) in enumerate(rows))
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= mixing.MAX_EPOCHS * r["size"]
        taken[r.source] += r.taken
        whole = r["size"] * (r.target // r.source_size) if r.source_size else 0
        assert whole <= r.taken <= whole + r["size"]
    for s, words in target.items():
        assert abs(taken[s] - words) <= 0.5
    partly = Counter(r.source for r in got if r["size"] and r.taken % r["size"])
    assert all(n == 1 for n in partly.values())  # one document of a source is cut at most


def mixed(spark, rows):
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, source string, size int, key string, target int")
    return mixing.mix(table).collect()


def test_mix_of_skewed_sources(spark):
    draw = random.Random(5)
    rows = [(i, "w " * draw.randint(0, 40), draw.choice(["hot"] * 6 + ["a", "b", "é", "Z", None, "", "ω", "𝒳"])) for i in range(1500)]
    got = mixed(spark, rows)
    check_mix(rows, got)
    again = mixed(spark, draw.sample(rows, len(rows)))
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_clamps_small_sources(spark):
    check_mix(rows := [(0, "one two", "a"), (1, "x " * 1000, "b"), (2, "y " * 500, "c"), (3, "z", "d"), (4, "", "e")], mixed(spark, rows))


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    check_mix([(r.doc_id, r.text, r.source) for r in odd_docs.collect()], got)
    assert mixing.mix(no_docs).collect() == []
    check_mix(rows := [(None, None, None), (1, "", "a")], mixed(spark, rows))
    check_mix(rows := [(1, "same text of copies", "a")] * 30 + [(2, "other", None)], mixed(spark, rows))


def test_new_queries_equal_their_twins(spark):
    con = duck(SF_SMALL)
    for key in ("op11_prefix_trie", "op12_source_mix"):
        ok, message, n = compare(QUERIES[key](spark, SF_SMALL), con, SQL[key])
        assert ok and n, f"{key}: {message}"


# --- token alignment -------------------------------------------------------------------------------


def token_bytes():
    """Both sides from the libraries alone: text -> (ids, bytes of each token)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment._path(alignment.SIDE_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment._path(alignment.SIDE_B))
    letters = {c: i for i, c in enumerate(sorted(set("".join(t for t in a.get_vocab() if len(t) == 1))))}
    assert len(letters) == 256
    byte_of = alignment._byte_letters()

    def side_a(text):
        e = a.encode(" " + text, add_special_tokens=False)
        return e.ids, [bytes(byte_of[c] for c in t) for t in e.tokens]

    def side_b(text):
        ids = b.encode(text)
        return ids, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(b.id_to_piece, ids), strict=True)]

    return side_a, side_b


def brute_alignment(texts):
    side_a, side_b = token_bytes()
    docs, counts = [], Counter()
    for text in texts:
        (a, bytes_a), (b, bytes_b) = side_a(text or ""), side_b(text or "")
        whole = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append(([], [], [], ""))
            continue
        spans = []
        for tokens in (bytes_a, bytes_b):
            at, found = 0, []
            for t in tokens:
                found.append((at, at + len(t)))
                at += len(t)
            spans.append(found)
        pairs, j0 = [], 0
        for i, (lo, hi) in enumerate(spans[0]):
            while spans[1][j0][1] <= lo:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < hi:
                pairs.append((a[i], b[j]))
                j += 1
        counts.update(pairs)
        cuts = sorted({hi for _, hi in spans[0]} & {hi for _, hi in spans[1]})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t) for t, (_, hi) in zip(ids, s, strict=True) if before < hi <= cut) for ids, s in ((a, spans[0]), (b, spans[1]))))
            before = cut
        docs.append((a, b, pairs, ";".join(groups)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(len(a), len(b), g.count(";") + 1 if g else 0, len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for a, b, p, g in docs]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.where("length(text) < 3000 and doc_id % 3 = 0").collect()}

    want = dict(zip(texts, brute_alignment(texts.values()), strict=True))
    table = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.alignments(table).collect()}
    assert got == want


ODD = [None, "", " ", "\n", "a", "a", "▁", "x▁y", "<s> </s> <unk> <0x41> <|endoftext|>", "tab\tand\r\nlines\x00nul \x1c\x85 ", "ﬁ é é 漢字かな 한글 🙂👩‍👩‍👧 ​﻿",
       "word" * 5000, "a b c " * 3000, "   many   spaces   ", "1234567890 3.14", "it's we'll I'D", "a", "Ünïcödé ΣΑΣ ς ퟿\U0010ffff"]


def test_alignment_of_odd_texts(spark, no_docs):
    table = spark.createDataFrame([(None if i == 4 else i // 2, t, 1, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_a int, key string").repartition(3)
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in alignment.alignments(table).collect())
    assert got == Counter((None if i == 4 else i // 2, *one) for i, one in enumerate(brute_alignment(ODD)))
    assert alignment.alignments(no_docs).collect() == [] and alignment.links(no_docs).collect() == []


def test_links_are_the_overlapping_token_positions(spark):
    got = {(r.a, r.b, r.a_id, r.b_id) for r in alignment.links(spark.createDataFrame([(1, "Grüße, unbelievably long words")], "doc_id long, text string")).collect()}
    (a, bytes_a), (b, bytes_b) = (side("Grüße, unbelievably long words") for side in token_bytes())
    ends = [[sum(map(len, t[:i + 1])) for i in range(len(t))] for t in (bytes_a, bytes_b)]
    assert got == {(i, j, a[i], b[j]) for i in range(len(a)) for j in range(len(b))
                   if ends[0][i] - len(bytes_a[i]) < ends[1][j] and ends[1][j] - len(bytes_b[j]) < ends[0][i]}
