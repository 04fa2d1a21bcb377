"""Pairs, scores and what is made of them, against plain loops; no step may hold or shuffle all pairs."""

import random

import numpy as np
import pytest

from kinfold.functions.similarity import similarities, similarity
from kinfold.operators import blocking, clustering, pairwise, scoring
from test_resolution import contact, resolution

GIVEN = ["Bob", "Robert", "Jack", "John", "J.R.", "Eric", "Erica", "Jo Ann", ""]


def people(n, seed=5):
    """Contacts with several e-mails and phones each, shared at random, in one large family and some small ones."""
    r = random.Random(seed)
    emails, phones = [f"e{i}@x.org" for i in range(12)] + ["unknown"], [f"21255500{i:02}" for i in range(12)] + ["0000000"]
    return [
        contact(
            i, r.choice(GIVEN), r.choice(["Smith", "Smith", "Smith", "Fox", ""]), r.choice(["icloud", "google"]), emails=[(e, "") for e in r.sample(emails, r.randrange(3))], phones=[(p, "") for p in r.sample(phones, r.randrange(3))],
            org=r.choice(["", "A", "B"]), birthday=r.choice(["", "1980-02-03", "--02-03", "1981-02-03", "x", "1980-01-01"]), middle_name=r.choice(["", "", "A.", "Ann", "B"]),
        )
        for i in range(n)
    ]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    """Nodes above the scoring of the pairs."""
    return plan(df).split("MapInArrow")[0]


@pytest.fixture(scope="module")
def mixed(spark):
    r = resolution(spark, *people(260))
    return r, r.norm.collect()


@pytest.mark.parametrize("block", [blocking.block_email, blocking.block_phone, blocking.block_family_large, blocking.candidate_pairs])
def test_pairs_are_neither_shuffled_nor_made_twice(mixed, block):
    r, rows = mixed
    many = {f for f in {x.family for x in rows} if f and sum(x.family == f for x in rows) > 50}

    def meets(x, y):
        email, phone = set(x.email_keys) & set(y.email_keys), set(x.phone_keys) & set(y.phone_keys)
        family = x.family != "" and x.family == y.family
        large = family and x.family in many and ((x.initial != "" and x.initial == y.initial) or (x.org_key != "" and x.org_key == y.org_key))
        return {"block_email": email, "block_phone": phone, "block_family_large": large, "candidate_pairs": email or phone or large or (family and x.family not in many)}[block.__name__]

    df = block(r.norm)
    assert "Exchange" not in final(df) and "Aggregate" not in final(df)
    assert sorted(map(tuple, df.collect())) == sorted((x.idx, y.idx) for x in rows for y in rows if x.idx < y.idx and meets(x, y))


def test_scores_do_not_depend_on_the_chunks(mixed, spark, monkeypatch):
    r, rows = mixed
    assert "Exchange" not in final(r.scored)
    want = sorted(map(tuple, r.scored.collect()))
    by = {x.idx: x for x in rows}
    for a, b, score, _, sim, _, email, phone, org, *_, nameless in want:
        x, y = by[a], by[b]
        assert (email, phone, org, nameless) == (bool(set(x.good_emails) & set(y.good_emails)), bool(set(x.good_phones) & set(y.good_phones)), x.org_key == y.org_key != "", "" in (x.given, y.given))
        assert sim == (0 if nameless else similarity(x.full, y.full)) and score <= 1
    monkeypatch.setattr(blocking, "BLOCK", 20)
    assert sorted(map(tuple, scoring.scored_pairs(r.rows).collect())) == want


def test_tiers_are_counted_where_the_pairs_are_made(mixed):
    r, _ = mixed
    df = scoring.tier_counts(r.rows)
    assert "SortMergeJoin" not in final(df) and "SortMergeJoin" not in plan(df).split("MapInArrow")[0]
    want = {}
    for x in r.scored.collect():
        want[x.tier] = want.get(x.tier, 0) + 1
    assert {x.tier: x.pairs for x in df.collect()} == want


def components(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {x: top(x) for x in root}


def linked(x):
    return x.tier != "distinct" and not near(x)


def near(x):
    return x.tier == "review" and x.score < 0.6 and not (x.shared_phone or x.shared_email or x.shared_birthday)


def test_evidence_from_narrower_keys(mixed):
    r, _ = mixed
    scored = r.scored.collect()
    want = components([(x.a, x.b) for x in scored if linked(x)])
    edges = scoring.evidence_edges(r.rows).collect()
    assert {x.idx: x.cluster for x in clustering.evidence_components(r.rows).collect()} == want
    assert len(edges) < sum(map(linked, scored))
    assert sorted(map(tuple, scoring.auto_pairs(r.rows).collect())) == sorted((x.a, x.b) for x in scored if x.tier == "auto_merge")


def test_near_names_are_matched_in_few_rounds(spark, monkeypatch):
    """One name borne by 60: each round used to match one pair of them."""
    r = resolution(spark, *[contact(i, "Maria", "Silva", "icloud" if i % 3 else "google") for i in range(60)])
    stored, real = [], clustering.materialize
    monkeypatch.setattr(clustering, "materialize", lambda df, name, *a: stored.append(name) or real(df, name, *a))
    none = r.contacts.select("idx").limit(0)
    got = {(x.a, x.b) for x in clustering.match_near_names(r.rows, none).collect()}
    assert stored.count("near-matched") == 1 and len(got) == 30
    edges = sorted((r.source[0] == r.source[1], *r.pair) for r in (_Edge(a, b) for a in range(60) for b in range(a + 1, 60)))
    taken, want = set(), set()
    for _, a, b in edges:
        if not {a, b} & taken:
            taken |= {a, b}
            want.add((a, b))
    assert got == want
    monkeypatch.setattr(clustering, "PREFIX", 300)
    assert {(x.a, x.b) for x in clustering.match_near_names(r.rows, none).collect()} == want


class _Edge:
    def __init__(self, a, b):
        self.pair, self.source = (a, b), tuple("icloud" if i % 3 else "google" for i in (a, b))


def test_clusters_and_what_is_said_of_them(mixed):
    r, _ = mixed
    scored, at = r.scored.collect(), {x.idx: x.cluster for x in r.placed.collect()}
    inner = {}
    for x in scored:
        if x.a in at and at[x.a] == at.get(x.b):
            inner.setdefault(at[x.a], []).append(x)
    for s in r.summary.collect():
        own = inner[s.cluster]
        best = min(own, key=lambda x: (-x.score, x.a, x.b))
        assert (s.pairs, s.min_score, s.max_score) == (len(own), min(x.score for x in own), best.score)
        assert (s.best.a, s.best.b, s.best.tier, s.best.name_similarity, s.best.shared_org) == (best.a, best.b, best.tier, best.name_similarity, best.shared_org)
        assert s.auto == (all(x.tier == "auto_merge" for x in own) and 2 * len(own) == s.size * (s.size - 1))
    from kinfold.operators import reporting

    names = {x.idx: x.name for x in r.contacts.selectExpr("idx", "formatted_name as name").collect()}
    said = {(x.a, x.b): x.said for x in reporting.ambiguity_rows(r.rows, r.placed, r.contacts.withColumn("formatted_name", r.contacts.formatted_name)).collect()}
    assert said.keys() == {(x.a, x.b) for own in inner.values() for x in own}
    assert all(said[x.a, x.b].endswith(f'scored {x.score:.2f} (tier: {x.tier})') and (not names[x.a] or names[x.a] in said[x.a, x.b]) for own in inner.values() for x in own)


def test_deferred_pairs_of_groups(mixed):
    r, _ = mixed
    at = {x.idx: x.idx for x in r.contacts.collect()} | {x.idx: x.cluster for x in r.placed.collect()}
    want = {}
    for x in r.scored.collect():
        if near(x) and at[x.a] != at[x.b]:
            key = tuple(sorted((at[x.a], at[x.b])))
            want[key] = max(want.get(key, 0), x.score)
    assert {(min(x.side_a), min(x.side_b)): x.score for x in r.deferred.collect()} == want


def test_many_similarities_are_the_single_ones():
    r = random.Random(1)
    names = ["", "x" * 70, "bob", "é"] + [(r.choice(["bob", "robert", "jack", "jo", "a", "é"]) + " " + "".join(r.choice("abcdé") for _ in range(r.randrange(14)))).strip() for _ in range(120)]
    a, b = (np.repeat(np.arange(len(names)), len(names)), np.tile(np.arange(len(names)), len(names)))
    assert (similarities(names, a, b) == np.array([similarity(names[i], names[j]) for i, j in zip(a, b, strict=True)])).all()
    assert len(pairwise.TIERS) == 3
