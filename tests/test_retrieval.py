import random
import re

from claimlake.operators import retrieval


def plainly(queries, evidence, k=3):
    words = lambda t: {w for w in re.findall(r"\w+", t.lower()) if len(w) > 2}
    out = []
    for claim, split, text in queries:
        q, best = words(text), {}
        for e, own, relation, t, s in evidence:
            if s != split or relation in ("SUPPORTS", "CONTRADICTS"):
                continue
            w = words(t)
            priority = 3 if own == claim else 2 if relation == "NEUTRAL" else 1
            found = (round(len(q & w) / len(q | w), 4) if q and w else 0.0, priority, e)
            best[t] = max(best.get(t, found), found)
        out += [(claim, e, s, at + 1) for at, (s, _, e) in enumerate(sorted(best.values(), reverse=True)[:k])]
    return sorted(out)


def test_hard_negatives_compare_classes(spark, monkeypatch):
    """Like all pairs, from few: queries that ask for the same words and texts that hold the same ones are compared once."""
    rnd = random.Random(3)
    queries = [(f"k{i}", rnd.choice("ab"), f"the store {rnd.choice(['red', 'blue'])} unit{i % 4} only{i}") for i in range(120)] + [("k900", "a", ""), ("k901", "c", "red"), ("k902", "b", "nothing known")]
    evidence = [(f"v{i}", f"k{rnd.randrange(140)}", rnd.choice(["NEUTRAL", "INSUFFICIENT", "SUPPORTS"]), f"report{i % 150} {rnd.choice(['red', 'green'])} store unit{rnd.randrange(5)}", rnd.choice("aab")) for i in range(300)]
    evidence += [("w1", "k900", "NEUTRAL", "  ", "a"), ("w2", "k1", "NEUTRAL", "", "b"), ("w3", "k901", "NEUTRAL", "red one", "c")]
    counts, nearest = [], retrieval._nearest

    def counted(*args, **options):
        found = nearest(*args, **options)
        counts.append(found.count())
        return found

    monkeypatch.setattr(retrieval, "_nearest", counted)
    got = retrieval.hard_negatives(spark.createDataFrame(queries, "claim_id string, split string, query_text string"), spark.createDataFrame(evidence, "evidence_id string, claim_id string, relation string, evidence_text string, split string"))
    assert sorted((r.claim_id, r.evidence_id, r.similarity, r["rank"]) for r in got.collect()) == plainly(queries, evidence)
    assert counts[0] < 300  # of 120 queries by 300 texts
