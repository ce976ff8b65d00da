"""Order MinHash, decontamination, packing, sharding, chats, licences."""

from __future__ import annotations

import random
from collections import Counter

import nasty
import numpy as np
import pytest

from cairn.llm import chat as C
from cairn.llm import common
from cairn.llm import decontaminate as D
from cairn.llm import licenses as N
from cairn.llm import order_minhash as O
from cairn.llm import packing as P
from cairn.llm import sharding as H

# shared


def test_word_hashes_don_t_depend_on_place():
    texts = [b"one two  one", b"", b"two\nthree", b"x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, doc = common.words(data, np.append(0, np.cumsum([len(t) for t in texts])))
    assert doc.tolist() == [0, 0, 0, 2, 2, 3]
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4


# order minhash


def plain_sketch(text, p):
    a, b = O.constants(p)
    h = O.kmer_hashes(text, p.k)
    seen, e = Counter(), []
    for x in h.tolist():
        e.append(int(O.mix(np.array([(x + seen[x] * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]) if max(Counter(h.tolist()).values()) > 1 else x)
        seen[x] += 1
    out = []
    for j in range(p.m):
        chosen = sorted(sorted(range(len(e)), key=lambda i: e[i] * int(a[j]) % 2**64)[: p.l])
        v = np.array([b[j]])
        for i in chosen:
            v = O.mix(v * np.uint64(0x100000001B3) + h[i])
        out.append(int(v.view(np.int64)[0]))
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdef", "abcdefg", "abababababababab", nasty.prose(4, 60), "é\U0001f600" * 20])
def test_sketch_equals_a_plain_one(text):
    p = O.Params(m=8)
    a, b = O.constants(p)
    assert O.sketch(text, p, a, b).tolist() == plain_sketch(text, p)


def test_one_repeat_changes_no_other_feature():
    p = O.Params(m=256)
    a, b = O.constants(p)
    text = "".join(chr(0x4E00 + i) for i in range(200))  # no 6-mer twice
    near = text + text[:6]
    h, again = O.kmer_hashes(text, p.k), O.kmer_hashes(near, p.k)
    assert len(set(h.tolist())) == len(h) and len(set(again.tolist())) < len(again)
    assert O.features(again)[: len(h)].tolist() == O.features(h).tolist()
    for x in (h, again):  # numbered without a switch
        seen, want = Counter(), []
        for v in x.tolist():
            want.append(int(O.mix(np.array([(v + seen[v] * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]))
            seen[v] += 1
        assert O.features(x).tolist() == want
    assert (O.sketch(text, p, a, b) == O.sketch(near, p, a, b)).mean() > 0.8


def test_sketch_of_a_long_text():
    p = O.Params(m=4)
    a, b = O.constants(p)
    text = nasty.prose(7, 6000)
    h = O.features(O.kmer_hashes(text, p.k))
    chosen = O.lowest(h, 3, a)
    for j in range(4):
        assert chosen[j].tolist() == sorted(np.argsort(h * a[j], kind="stable")[:3].tolist())


def test_signatures_see_order():
    p = O.Params(m=256)
    a, b = O.constants(p)
    text = nasty.prose(8, 300)
    edited, turned = text.replace("the", "teh", 3), text[len(text) // 2 :] + text[: len(text) // 2]
    same = lambda x: (O.sketch(text, p, a, b) == O.sketch(x, p, a, b)).mean()
    assert same(text) == 1 and same(edited) > 0.6 > same(turned)


def test_fingerprints_of_odd_rows(spark):
    docs = nasty.documents(spark)
    got = O.fingerprints(docs).collect()
    assert len(got) == docs.count()
    assert all((r.signature is None) == (r.kmers == 0) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].signature == by[2].signature != by[3].signature and by[4].signature is None and len(by[5].signature) == 32
    assert O.fingerprints(nasty.empty(spark)).collect() == []


# decontamination


def brute_force(docs, items, p):
    """Every passage against every item."""
    (ix,) = D.indexes(items, p)
    out = set()
    for k, text in docs:
        words = [ix.terms.get(t, -1) for t in D.tokens(text.encode())] if text else []
        halves = -(-len(words) // ix.half)
        for h in range(max(1, halves - 1)) if words else ():
            own = words[h * ix.half : (h + 2) * ix.half]
            for i in range(len(ix.ids)):
                score = sum(lists[1][lists[0].index(i)] for t in set(own) if t >= 0 and i in (lists := ix.postings[t])[0])
                if score < p.threshold:
                    continue
                parts = [None if side is None else np.mean([g in set(D.grams(own, min(p.n, len(side)))) for g in D.grams(side, p.n)]) for side in (ix.questions[i], ix.answers[i])]
                if parts[0] >= p.overlap and (parts[1] is None or parts[1] >= p.overlap) or parts[0] >= p.question_alone:
                    out.add((k, ix.ids[i]))
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(2)
    items = [(i, nasty.prose(100 + i, r.randint(6, 40)) + ". Answer " + nasty.prose(300 + i, 5) + ".") for i in range(30)]
    docs = []
    for k in range(60):
        body = nasty.prose(500 + k, r.randint(0, 200)).split()
        if k % 3 == 0:
            item = items[k % 30][1].split()
            cut = len(item) if k % 2 == 0 else r.randint(1, len(item))
            at = r.randint(0, len(body))
            body[at:at] = item[:cut]
        docs.append((k, " ".join(body)))
    p = D.Params()
    got = {(x.doc_id, x.item_id) for x in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), p).collect()}
    want = brute_force(docs, items, p)
    assert got == want and len(want) >= 10


def test_wand_finds_all_above_the_threshold():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(3, 20)))) for i in range(200)]
    (ix,) = D.indexes(items, D.Params(blocks=16))
    for threshold in (0.2, 0.5, 0.9):
        for _ in range(30):
            query = sorted({ix.terms[w] for w in r.sample(words, 25) if w in ix.terms})
            scores = np.zeros(len(ix.ids))
            for t in query:
                scores[ix.postings[t][0]] += ix.postings[t][1]
            assert {i for i, _ in D.wand(ix, query, threshold)} == set(np.flatnonzero(scores >= threshold - 1e-6).tolist())


def test_leaks_of_odd_rows(spark):
    docs = nasty.documents(spark)
    items = spark.createDataFrame([(1, docs.where("doc_id = 6").first().text), (2, None), (3, ""), (None, nasty.prose(5, 60)), (5, "!!"), (6, nasty.prose(11, 90)), (6, nasty.prose(11, 90))], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect())
    assert got[(10, 6)] == 2 and got[(None, None)] == 1 and got[(6, 1)] == 1
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 2, 8: 1, 9: 1, None: 1, 10: 1})
    assert D.contaminated(docs, items.limit(0)).collect() == [] and D.clean(docs, items.limit(0)).count() == docs.count()
    assert D.contaminated(nasty.empty(spark), items).collect() == []


def test_several_indexes_find_the_same(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = lambda p: {(r.doc_id, r.item_id) for r in D.contaminated(docs, items, p).collect()}
    assert rows(D.Params()) == rows(D.Params(items_per_index=7)) != set()


# packing


def test_cuts_are_of_least_cost():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 25)
        p = P.Params(capacity=20, split_penalty=3, break_penalty=9)
        tokens, kinds = [r.randint(1, 20) for _ in range(n)], [*(r.randint(0, 2) for _ in range(n - 1)), 0]
        length = [0, *np.cumsum(tokens).tolist()]
        cost = [0] + [None] * n
        for i in range(1, n + 1):
            cost[i] = min(cost[j] + 20 - (length[i] - length[j]) + (0, 3, 9)[kinds[i - 1]] for j in range(i) if length[i] - length[j] <= 20)
        total = at = 0
        for end in P.cuts(tokens, kinds, p):
            assert length[end] - length[at] <= 20
            total += 20 - (length[end] - length[at]) + (0, 3, 9)[kinds[end - 1]]
            at = end
        assert total == cost[n]


def test_counts_are_those_of_the_whole_text(spark, sf):
    p = P.Params()
    e, _, _ = P.encoding(p)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text] + ["a", " a", "a ", "a\nb. c", "\n", "a  b\tc", "x" * 20000, " ", "a b c"]
    for t, (tokens, chars, kinds) in zip(texts, P.units_of([t.encode() for t in texts], p), strict=True):
        assert sum(chars) == len(t) and kinds[-1] == P.DOCUMENT and max(tokens) <= p.capacity
        if P.BREAK not in kinds and "  " not in t and " " not in t and t.strip() == t and "\t" not in t:
            assert sum(tokens) == len(e.encode_ordinary(t)) + 1


def test_windows_hold_every_document_once_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p = P.Params(docs_per_run=50, capacity=256)
    rows = sorted(P.packed(docs, p).collect(), key=lambda r: (r.run, r.window))
    assert all(r.tokens + r.padding == 256 and r.padding >= 0 and r.tokens == sum(s.tokens for s in r.spans) for r in rows)
    seen: dict[int, int] = {}
    order = []
    for r in rows:
        for s in r.spans:
            assert s.start == seen.get(s.doc_id, 0) and s.doc_id // 50 == r.run
            seen[s.doc_id] = s.end
            order.append(s.doc_id)
    assert order == sorted(order)
    assert seen == {r.doc_id: len(r.text) for r in docs.collect() if r.text}


def test_runs_hold_equal_numbers_of_documents_whatever_the_ids(spark):
    schema = "doc_id long, text string"
    texts = [nasty.prose(800 + i, 20) for i in range(70)]
    p = P.Params(docs_per_run=20, capacity=256)

    def windows(ids, texts=texts):
        rows = sorted(P.packed(spark.createDataFrame(list(zip(ids, texts, strict=True)), schema).repartition(5), p).collect(), key=lambda r: (r.run, r.window))
        return rows, Counter(r.run for r in rows for s in r.spans if s.start == 0)

    dense, sizes = windows(range(70))
    assert sizes == {0: 20, 1: 20, 2: 20, 3: 10}
    for ids in ([i * 2**40 + 1 for i in range(70)], [i * 5000 - 170000 for i in range(70)]):
        rows, sizes = windows(ids)
        assert sizes == {0: 20, 1: 20, 2: 20, 3: 10}
        assert [(r.run, r.window, r.tokens, r.cut, [(ids.index(s.doc_id), s.start, s.end) for s in r.spans]) for r in rows] == [(r.run, r.window, r.tokens, r.cut, [(s.doc_id, s.start, s.end) for s in r.spans]) for r in dense]
    assert sorted(windows([7] * 70)[1].values()) == [10, 20, 20, 20]  # one id
    rows, sizes = windows([2**60 + i for i in range(25)] + [None] * 45)
    assert sizes == {0: 20, 1: 5, 2: 20, 3: 20, 4: 5} and {s.doc_id for r in rows for s in r.spans} == {None} | {2**60 + i for i in range(25)}
    same = windows([None] * 70, texts[:1] * 70)[1]
    assert sum(same.values()) == 70 and len(same) > 1 and max(same.values()) < 70


def test_packing_of_odd_rows(spark):
    docs = nasty.documents(spark)
    rows = P.packed(docs).collect()
    ids = Counter(s.doc_id for r in rows for s in r.spans if s.start == 0)
    assert ids == Counter({1: 1, 2: 1, 3: 1, 6: 1, 7: 2, 8: 1, 9: 1, 10: 2, None: 1})
    assert P.packed(nasty.empty(spark)).collect() == []


# sharding


def weights(links, shards):
    of = {r.doc_id: r.shard for r in shards}
    return sum(r.weight for r in links if of[r.a] != of[r.b]) / 2


def test_shards_are_even_and_cut_less(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p = H.Params(shards=4, rounds=6)
    links = H.links(docs, p).collect()
    first, got = H.first_shards(docs, p).collect(), H.shards(docs, p).collect()
    sizes = Counter(r.shard for r in got)
    n = docs.count()
    assert sum(sizes.values()) == n == len({r.doc_id for r in got})
    assert max(sizes.values()) <= max(int(n / 4 * 1.05), -(-n // 4)) and min(sizes.values()) >= int(n / 4 * 0.95)
    assert max(Counter(r.shard for r in first).values()) - min(Counter(r.shard for r in first).values()) <= 1
    assert weights(links, got) < 0.8 * weights(links, first)


def test_links_equal_plain_ones(spark):
    line, other = "a line that is long enough to be a passage of text", "another line that is long enough to be one as well"
    docs = spark.createDataFrame([(1, f"{line}\nshort"), (2, f"{other}\n{line}"), (3, line), (4, other), (5, "short"), (6, f"{line}\n{line}")], "doc_id long, text string")
    got = {(r.a, r.b): r.weight for r in H.links(docs).collect()}
    third = pytest.approx(1 / 3)
    want = {(1, 2): third, (1, 3): third, (2, 3): third, (1, 6): third, (3, 6): third, (2, 4): 1.0}
    assert got == want | {(b, a): w for (a, b), w in want.items()}
    parts = {(r.a, r.b) for r in H.links(docs, H.Params(part=1)).collect()}
    assert all((b, a) in parts for a, b in parts)
    reach, grown = {1}, True
    while grown:
        grown = bool(more := {b for a, b in parts if a in reach} - reach)
        reach |= more
    assert reach >= {1, 2, 3, 6}


def test_near_copies_and_quotations_are_linked(spark):
    lines = [nasty.prose(700 + i, 24) for i in range(6)]
    edited = [" ".join([*x.split()[:20], "changed", *x.split()[21:]]) for x in lines]
    quoted = nasty.prose(720, 15)
    docs = [
        (1, "\n".join(lines)),
        (2, "\n".join(edited)),  # an edit in each line
        (3, f"{nasty.prose(730, 9)} {quoted} {nasty.prose(731, 11)}"),
        (4, f"{nasty.prose(732, 14)} {quoted} {nasty.prose(733, 3)}"),  # a quotation inside a line
        (5, " ".join(nasty.prose(740, 40).split())),
        (6, "\n".join(" ".join(nasty.prose(740, 40).split()[i : i + 5]) for i in range(0, 40, 5))),  # other line ends
        (7, nasty.prose(750, 60)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.a, r.b) for r in H.links(df).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3), (5, 6), (6, 5)}


def test_shared_runs_of_words_are_seen_wherever_they_stand():
    p, r = H.Params(), random.Random(3)
    for k in range(200):
        shared = [f"s{k}w{i}" for i in range(p.gram + p.window - 1)]
        a, b = ([f"{x}{k}w{i}" for i in range(r.randint(0, 40))] + shared + [f"{x}{k}v{i}" for i in range(r.randint(0, 40))] for x in "ab")
        texts = [r.choice((" ", "\n")).join(a).encode(), b"", "\n".join(b).encode(), b"few words"]
        of, h, _ = H.winnowed(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])), p)
        assert set(h[of == 0].tolist()) & set(h[of == 2].tolist()) and set(of.tolist()) == {0, 2}


def test_quotas_keep_sizes():
    r = random.Random(4)
    for _ in range(200):
        sizes = {s: r.randint(80, 120) for s in range(5)}
        asked = {(s, t): r.randint(0, 60) for s in range(5) for t in range(5) if s != t and r.random() < 0.7}
        got = H.quotas(asked, sizes, 80, 120)
        after = {s: n + sum(k for (_, t), k in got.items() if t == s) - sum(k for (f, _), k in got.items() if f == s) for s, n in sizes.items()}
        assert all(80 <= n <= 120 for n in after.values()) and all(0 <= got[k] <= asked[k] for k in asked)


def test_shards_of_odd_rows(spark):
    got = H.shards(nasty.documents(spark)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 11)) and all(0 <= r.shard < 16 for r in got)
    assert H.shards(nasty.empty(spark)).collect() == []


# chats

TURNS = [("system", "be brief"), ("user", "a\nb"), ("assistant", "x\ny"), ("user", ""), ("assistant", "z")]


@pytest.mark.parametrize("name", ["chatml", "bracketed"])
def test_spans_rebuild_the_string(name):
    text, spans, rewritten = C.render(TURNS, C.TEMPLATES[name])
    assert text == C.TEMPLATES[name](TURNS) and rewritten == []
    for (role, said), (a, b) in zip(TURNS, spans, strict=True):
        assert said in text[a:b] or role == "system"
    assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_spans_of_chatml_are_the_turns():
    text, spans, _ = C.render(TURNS, C.chatml)
    assert [text[a:b] for a, b in spans] == [C.chatml([t]) for t in TURNS]


def test_rewritten_history_is_seen():
    text, spans, rewritten = C.render(TURNS, C.last_answer_only)
    assert rewritten == [4] and text == C.last_answer_only(TURNS)
    assert [text[s[0] : s[1]] if s else None for s in spans[:2]] == ["<system>be brief</system>", "<user>a\nb</user>"] and spans[2] is None
    assert C.render([], C.chatml) == ("", [], [])
    shout = lambda turns: " ".join(t for _, t in turns).upper() + f"#{len(turns)}"
    assert C.render(TURNS[:3], shout)[2] == [0, 1, 2] or C.render(TURNS[:3], shout)[2]


def test_conversations(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    got = C.formatted(c).collect()
    rows = c.collect()
    assert len(got) == len({r.conv_id for r in rows})
    for g in got:
        turns = sorted((r.turn, r.role, r.text) for r in rows if r.conv_id == g.conv_id)
        assert g.text == C.chatml([t[1:] for t in turns]) and not g.rewrites
        assert [g.text[s.start : s.end] for s in g.spans] == [C.chatml([t[1:]]) for t in turns]


def test_conversations_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, r int"
    rows = [(1, 0, "user", None, "x", 1), (1, 0, "user", None, "x", 1), (1, None, None, "t", "x", 1), (None, 1, "user", "q", "x", 1), (2, 1, "user", "w " * 50000, "x", 1)]
    got = {r.conv_id: r for r in C.formatted(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 3 and [s.turn for s in got[1].spans] == [None, 0, 0] and got[None].text == C.chatml([("user", "q")])
    assert C.formatted(spark.createDataFrame([], schema)).collect() == []


# licences


@pytest.mark.parametrize(
    ("expression", "allowed"),
    [
        ("MIT", True), ("mit", True), ("GPL-3.0-only", False), ("MIT OR GPL-3.0-only", True), ("MIT AND GPL-3.0-only", False), ("GPL-3.0-only OR MIT AND Apache-2.0", True),
        ("(GPL-3.0-only OR MIT) AND GPL-2.0-only", False), ("Apache-2.0 WITH LLVM-exception", True), ("Apache-2.0 WITH Unknown-exception", False), ("((MIT))", True),
        ("MIT AND", None), ("(MIT", None), ("MIT)", None), ("MIT GPL", None), ("WITH MIT", None), ("(MIT OR X) WITH LLVM-exception", None), ("", None), ("MIT WITH (X)", None), ("MIT & X", None),
    ],
)
def test_expressions(expression, allowed):
    postfix = N.to_postfix(expression)
    assert (N.evaluate(postfix, N.Policy()) if postfix else None) is allowed


def test_findings_equal_a_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    policy = N.Policy()
    got = {r.doc_id: sorted((f.start, f.expression) for f in r.findings) for r in N.scan(docs).collect()}
    import re

    for r in docs.collect():
        low = r.text.lower()
        want = sorted((m.start(), i) for phrase, i in policy.phrases.items() for m in re.finditer(rf"(?=(?<!\w){re.escape(phrase)}(?!\w))", low))
        assert got[r.doc_id] == want
    assert any(got.values())


def test_licences_of_odd_rows(spark):
    extra = [
        (30, "# SPDX-License-Identifier: MIT OR GPL-3.0-only\ncode\nspdx-license-identifier: GPL-3.0-only */"),
        (31, "SPDX-License-Identifier:"),
        (32, "SPDX-License-Identifier: MIT AND ("),
        (33, "İ Released under the MIT License. Xreleased under the mit license"),
    ]
    docs = nasty.documents(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    rows = N.scan(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert [(f.start, f.kind, f.expression, f.valid, f.allowed) for f in by[30].findings] == [(2, "tag", "MIT OR GPL-3.0-only", True, True), (52, "tag", "GPL-3.0-only", True, False)] and not by[30].allowed
    assert [(f.expression, f.valid) for f in by[31].findings] == [("", False)] and [(f.expression, f.valid) for f in by[32].findings] == [("MIT AND (", False)]
    assert [(f.start, f.expression) for f in by[33].findings] == [(2, "MIT")]
    assert by[4].findings == [] and by[4].allowed
    assert N.scan(nasty.empty(spark)).collect() == []


# cases of decontamination, packing and near-dedup that sizes or ids must not change


def test_a_long_item_changes_nothing_for_short_ones(spark):
    item = " ".join(f"word{i}" for i in range(12))
    words = item.split()
    scattered = " ".join(f"{nasty.prose(60 + k, 190)} {' '.join(words[3 * k : 3 * k + 3])}" for k in range(4))
    docs = spark.createDataFrame([(1, scattered), (2, f"{nasty.prose(70, 50)} {item} {nasty.prose(71, 50)}")], "doc_id long, text string")
    long_item = (2, nasty.prose(80, 3000) + ". Answer " + nasty.prose(81, 6) + ".")
    for items in ([(1, item)], [(1, item), long_item]):
        found = D.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert [(r.doc_id, r.item_id) for r in found] == [(2, 1)]
    whole = spark.createDataFrame([(3, f"{nasty.prose(90, 700)} {long_item[1]} {nasty.prose(91, 700)}")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.contaminated(whole, spark.createDataFrame([(1, item), long_item], "item_id long, text string")).collect()] == [(3, 2)]


def test_short_answers_stand_with_their_question(spark):
    question = " ".join(f"term{i}" for i in range(20))
    item = f"{question}\nParis"
    far = " ".join(question.split()[:14]) + " " + nasty.prose(95, 30) + " Paris"  # of the question enough, the answer elsewhere
    near = " ".join(question.split()[:14]) + " Paris " + nasty.prose(95, 30)
    docs = spark.createDataFrame([(1, far), (2, near)], "doc_id long, text string")
    assert [r.doc_id for r in D.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [2]


def test_stretches_equal_plain_ones():
    r, p = random.Random(8), D.Params(n=2)
    for _ in range(300):
        words, q = [r.randint(0, 5) for _ in range(r.randint(1, 30))], [r.randint(0, 5) for _ in range(r.randint(1, 8))]
        a = [r.randint(0, 5) for _ in range(r.randint(1, 3))] if r.random() < 0.7 else None
        size = r.randint(2, 15)
        best = None
        for at in range(len(words)):
            own = words[at : at + size]
            s = [None if x is None else np.mean([g in set(D.grams(own, min(2, len(x)))) for g in D.grams(x, 2)]) for x in (q, a)]
            if (s[0] >= p.overlap and (s[1] is None or s[1] >= p.overlap)) or s[0] >= p.question_alone:
                key = (s[0], -1.0 if s[1] is None else s[1])
                best = max(best, key) if best else key
        got = D.together(words, q, a, size, p)
        assert (got is None) == (best is None)
        if got:
            assert got[0] == pytest.approx(best[0]) and (got[1] is None or got[1] == pytest.approx(best[1]))


def test_sentences_that_fill_windows_are_counted_whole():
    p = P.Params(capacity=256)
    e = P.encoding(p)[0]
    r = random.Random(12)
    texts = [
        " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(3000)),  # one sentence
        "x" * 5000,
        "中文\U0001f600" * 900,
        "a  b\t\tc \n\n d. " * 700 + "  end  ",
        "first. " + "éü " * 2000 + ". last",
    ]
    for t in texts:
        ends = P.token_ends(t, e)
        assert len(ends) == len(e.encode_ordinary(t)) and ends[-1] == len(t) and (np.diff(ends) >= 0).all()
        ((tokens, chars, kinds),) = P.units_of([t.encode()], p)
        assert sum(tokens) == len(e.encode_ordinary(t)) + 1 and sum(chars) == len(t)
        assert max(tokens) <= p.capacity and min(chars) >= 0 and kinds[-1] == P.DOCUMENT


def test_blocks_of_long_texts_change_no_token(monkeypatch):
    monkeypatch.setattr(P, "_BLOCK", 50)
    e = P.encoding(P.Params())[0]
    r = random.Random(13)
    for _ in range(40):
        t = "".join(r.choice(["word", " ", "  ", "\n", "\t", "1", "23", "'s", "é", "中", ".", "!?"]) for _ in range(r.randint(0, 400)))
        n = [len(e.decode_bytes(e.encode_ordinary(t)[: k + 1]).decode("utf-8", "ignore")) for k in range(len(e.encode_ordinary(t)))]
        assert P.token_ends(t, e).tolist() == n


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([(f"d{i:02d}", nasty.prose(i // 2, 80)) for i in range(20)] + [(None, "x")], "doc_id string, text string")
    assert {s.doc_id for r in P.packed(docs).collect() for s in r.spans} == {f"d{i:02d}" for i in range(20)} | {None}
    assert {r.doc_id for r in O.fingerprints(docs).collect()} == {f"d{i:02d}" for i in range(20)} | {None}
    assert {r.doc_id for r in H.shards(docs).collect()} == {f"d{i:02d}" for i in range(20)}


def plain_shards(links, first, p):
    """The rounds, document by document."""
    weight: dict[int, dict[int, float]] = {}
    for r in links:
        weight.setdefault(r.a, {})[r.b] = r.weight
    own = dict(first)
    total = len(own)
    least, most = int(total * (1 - p.slack) / p.shards), max(int(total * (1 + p.slack) / p.shards), -(-total // p.shards))
    best, best_cut, stale = dict(own), None, 0
    for turn in range(100):
        state = {}
        for a, near in weight.items():
            w: dict[int, float] = {}
            for b, x in near.items():
                w[own[b]] = w.get(own[b], 0.0) + x
            w = {s: round(x, 9) for s, x in w.items()}
            to = max(w, key=lambda s: (w[s], -s))
            mine = w.get(own[a], 0.0)
            state[a] = (to, w[to] - mine, sum(w.values()) - mine)
        cut = sum(x[2] for x in state.values())
        stale = stale + 1 if best_cut is not None and cut > best_cut * (1 - p.least_progress) else 0
        if best_cut is None or cut < best_cut:
            best, best_cut = dict(own), cut
        if not cut or stale >= 3:
            return best
        may = [a for a, (to, gain, _) in state.items() if gain > 1e-9 and to != own[a] and H_HASH(a, p.seed + 1 + turn) % 2 == 0]
        asked = Counter((own[a], state[a][0]) for a in may)
        sizes = Counter(own.values())
        allowed = H.quotas(dict(asked), {s: sizes.get(s, 0) for s in range(p.shards)}, least, most)
        went: Counter = Counter()
        for a in sorted(may, key=lambda a: (-state[a][1], H_HASH(a, p.seed), a)):
            way = (own[a], state[a][0])
            if went[way] < allowed[way]:
                went[way] += 1
                state[a] = (*state[a], True)
        own = {a: state[a][0] if len(state.get(a, ())) == 4 else s for a, s in own.items()}
    raise AssertionError


def H_HASH(a, seed):  # noqa: N802
    return HASHES[a, seed]


HASHES: dict[tuple[int, int], int] = {}


def test_shards_equal_a_plain_propagation(spark):
    import pyspark.sql.functions as F

    r = random.Random(6)
    pool = [nasty.prose(900 + k, 20) for k in range(40)]
    rows = [(i, "\n".join(r.sample(pool[10 * (i % 4) : 10 * (i % 4) + 10], 3) + [r.choice(pool)])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = H.Params(shards=4, slack=0.1)
    for seed in [p.seed + k for k in range(60)]:
        for x in docs.select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("h")).collect():
            HASHES[x.doc_id, seed] = x.h
    first = {x.doc_id: x.shard for x in H.first_shards(docs, p).collect()}
    want = plain_shards(H.links(docs, p).collect(), first, p)
    assert {x.doc_id: x.shard for x in H.shards(docs, p).collect()} == want != first


def test_templates_that_raise():
    def strict(turns):
        if not turns:
            raise IndexError("list index out of range")
        if turns[-1][0] == "system":
            raise ValueError("a conversation can't end so")
        return C.chatml(turns)

    text, spans, rewritten, failed, error = C.attempt(TURNS, strict)
    assert text == C.chatml(TURNS) and failed == [0] and rewritten == [] and error is None
    assert spans[0] is None and [text[a:b] for a, b in spans[1:]] == [C.chatml(TURNS[:2]), *(C.chatml([t]) for t in TURNS[2:])]
    assert C.attempt(TURNS[:1], strict)[0] is None and C.attempt([], strict)[4].args == ("list index out of range",)
    with pytest.raises(ValueError, match="end so"):
        C.render(TURNS[:1], strict)


def test_a_template_that_raises_keeps_the_job(spark):
    def picky(turns):
        if any("bad" in t for _, t in turns):
            raise ValueError("bad word")
        return C.chatml(turns)

    rows = [(1, 0, "user", "bad"), (2, 0, "user", "fine"), (2, 1, "assistant", "yes")]
    got = {r.conv_id: r for r in C.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), picky).collect()}
    assert got[1].text is None and got[1].error == "ValueError: bad word" and got[1].failed_at == [0] and got[1].spans[0].start is None
    assert got[2].text == C.chatml([("user", "fine"), ("assistant", "yes")]) and got[2].error is None and got[2].failed_at == []


@pytest.mark.parametrize("name", sorted(C.TEMPLATES))
def test_every_template_over_the_whole_table(spark, sf, name):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = c.collect()
    for g in C.formatted(c, C.TEMPLATES[name]).collect():
        turns = [t[1:] for t in sorted((r.turn, r.role, r.text) for r in rows if r.conv_id == g.conv_id)]
        assert g.text == C.TEMPLATES[name](turns)
        outputs = [C.TEMPLATES[name](turns[:i]) for i in range(len(turns) + 1)]
        grown = [any(after == before[:k] + after[k : k + len(after) - len(before)] + before[k:] for k in range(len(before) + 1)) if len(after) >= len(before) else False for before, after in zip(outputs, outputs[1:], strict=False)]
        assert g.rewrites == (not all(grown)) and len(g.rewritten_at) == grown.count(False)
        assert all(g.text[s.start : s.end] or t[0] == "system" for s, t in zip(g.spans, turns, strict=True) if s.start is not None)


def test_wrapped_notices_and_prose_after_tags():
    policy = N.Policy()
    a = N.automaton(policy)
    for text, want in (
        ("Permission is hereby granted, free of charge, to any\nperson obtaining a copy", [(0, "MIT", True)]),
        (" * Redistribution and use in source\n * and binary forms", [(3, "BSD-3-Clause", True)]),
        ("# x\n#   Licensed under the Apache License,\n#   Version 2.0.", [(8, "Apache-2.0", True)]),
        ("it is under the\tGNU  Lesser General Public\r\n// License, version 3", [(16, "LGPL-3.0-only", False)]),
        ("the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of", [(4, "GPL-3.0-or-later", False)]),
        ("SPDX-License-Identifier: MIT. This file", [(0, "MIT", True)]),
        ("SPDX-License-Identifier: MIT -- note", [(0, "MIT", True)]),
        ("// x\n// SPDX-License-Identifier:\tApache-2.0+, or so\nMIT", [(8, "Apache-2.0+", True)]),
        ("SPDX-License-Identifier: GPL-3.0-only OR MIT; see", [(0, "GPL-3.0-only OR MIT", True)]),
        ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", [(0, "Apache-2.0 WITH LLVM-exception", True)]),
    ):
        assert [(f["start"], f["expression"], f["allowed"]) for f in N.findings(text, a, policy)] == want, text
    for text in ("a  b\n\n* c", "", " ", "x\n", "\n# y", "a\t", "no change"):
        short, ours, theirs = N.unwrapped(text)
        assert len(ours) == len(theirs) and "\n" not in short
