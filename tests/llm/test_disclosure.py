"""Operator 3: telling terms away from the entity and in documents without it."""

import math
import random
from collections import defaultdict

import pytest
from cases import hostile

from sagaframe.llm import pii
from sagaframe.llm.common import cut


@pytest.mark.parametrize("limit", [200_000, -1])
def test_telling_terms_everywhere(spark, monkeypatch, limit):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", limit)
    r = random.Random(3)
    some = lambda n: " ".join(r.choice("the lies grey house seldom quiet river stone".split()) for _ in range(n))
    rows = [(i, f"Xanthippe {some(20)} Zebulon mail ann@example.org {some(12)} zebulon {some(3)}") for i in range(12)]
    rows += [(50 + i, some(40)) for i in range(60)]
    rows += [(200, f"{some(9)} XANTHIPPE {some(9)}"), (201, f"{some(4)} Zebulon"), (201, f"{some(4)} Zebulon")]
    df = hostile(spark, [(d, t, None, None) for d, t in rows])
    want = {(d, s, s + 9 if t[s].lower() == "x" else s + 7) for d, t in rows for w in ("xanthippe", "zebulon") for s in range(len(t)) if t.lower().startswith(w, s)}
    got = pii.personal_data(df, min_bits=2).select("doc_id", "spans").collect()
    texts = dict(rows)
    found = {(x["doc_id"], s["start"], s["end"]) for x in got for s in x["spans"] if s["kind"] == "term" and texts[x["doc_id"]][s["start"] : s["end"]] != "mail"}
    assert len(got) == len(rows) and found == want
    clean = {x["doc_id"]: x["text"].lower() for x in pii.sanitise(df, min_bits=2).collect()}
    assert not any(w in t for t in clean.values() for w in ("xanthippe", "zebulon"))


def plain(texts, least, share, bits):
    """(entity, term) pairs by counting over the documents, with surroundings as strings."""
    surroundings, both, having, holding = defaultdict(lambda: (set(), set())), defaultdict(int), defaultdict(int), defaultdict(int)
    for text in texts:
        spans = pii.base_spans(text or "")
        every = [(m[0].lower(), m.start(), m.end()) for m in pii._TERM.finditer(text or "")]
        for term in {t for t, _, _ in every}:
            having[term] += 1
        free = [x for x in every if not any(a < x[2] and x[1] < b for _, a, b in spans)]
        words, seen = [x[0] for x in free], set()
        window = lambda i, j: (tuple(words[max(0, i - 5) : i]), tuple(words[j : j + 5]))
        for kind, a, b in spans:
            entity = f"{kind}:{text[a:b].lower()}"
            if entity in seen:
                continue
            seen.add(entity)
            holding[entity] += 1
            at = sum(x[1] < a for x in free)
            for term in set(words):
                i = words.index(term)
                surroundings[entity, term][0].add(window(at, at))
                surroundings[entity, term][1].add(window(i, i + 1))
                both[entity, term] += 1
    return {(e, t) for (e, t), n in both.items() if min(map(len, surroundings[e, t])) >= least and n >= share * having[t] and math.log2(n / having[t] * len(texts) / holding[e]) >= bits}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_disclosing_terms_by_counting(spark, seed):
    r = random.Random(seed)
    common, names = [f"w{c}{d}x" for c in "abcdefgh" for d in "ijk"], ["Zeno", "Ruth", "Otto", "Mina"]
    texts = [None, "", "ann@example.org"]
    for _ in range(90):
        words = r.choices(common, k=r.randrange(3, 40))
        for _ in range(r.randrange(0, 3)):
            i = r.randrange(4)
            words[r.randrange(len(words))] = f"{names[i].lower()}@example.org" if r.random() < 0.6 else "10.0.0.7"
            if r.random() < 0.8:
                words.insert(r.randrange(len(words)), names[i])
        texts.append(" ".join(words))
    texts += r.choices(texts, k=25)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = pii.disclosing(df, "text", cut(pii.find(df, "doc_id", "text")), 3, 0.3, 0.5)
    want = plain(texts, 3, 0.3, 0.5)
    assert want and {(x["entity"], x["term"]) for x in got.collect()} == want


def test_copies_and_repeats_are_no_evidence(spark):
    r = random.Random(4)
    some = lambda n: " ".join(r.choice("the lies grey house seldom quiet river stone".split()) for _ in range(n))
    rows = [(0, " ".join(f"Xanthippe {some(7)} ann@example.org {some(9)}" for _ in range(9)))]
    copied = f"{some(9)} Zebulon {some(12)} bob@example.org {some(9)}"
    rows += [(i, f"{some(3)} {copied} {some(3)}") for i in range(1, 9)]
    rows += [(i, some(30)) for i in range(20, 60)]
    for x in pii.personal_data(hostile(spark, [(d, t, None, None) for d, t in rows]), min_bits=1).collect():
        assert x["spans"] == x["base"]
