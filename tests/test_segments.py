"""The segment join against all pairs, and what it compares in a hot group."""

import random

import brute
import pytest

from siteweave.functions.scoring import MatchConfig
from siteweave.operators import linkage, segments

WORDS = "ACME BOLT GEAR STEEL WORKS CORP INC NORTH RIVER TOOL CASTING VALLEY UNION PRESS METAL".split()


def names(draw, n):
    """Names of a few words with letters of their own, and misspelt copies of some."""
    out = []
    for _ in range(n):
        own = "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(draw.randint(3, 9)))
        name = " ".join([own, *draw.sample(WORDS, draw.randint(1, 3))])
        out.append(name)
        for _ in range(draw.choice([0, 0, 1, 2])):
            changed = list(name)
            for _ in range(draw.randint(1, 1 + len(name) // 5)):
                at = draw.randrange(len(changed))
                changed[at : at + 1] = draw.choice([[], ["X"], [changed[at], "É"]])
                changed = changed or ["A"]
            out.append("".join(changed))
    return out


@pytest.mark.parametrize("seed, loss", [(1, 0.31), (2, 0.076), (3, 0.0), (4, 0.45)])
def test_like_all_pairs(spark, seed, loss):
    draw = random.Random(seed)
    found = [("g" if draw.random() < 0.8 else "h", n) for n in names(draw, 60)] + [("g", ""), ("g", None), ("h", "A"), ("h", "B"), ("h", "AB")]
    rows = [(g, n, loss) for g, n in found]
    got = segments.alike(spark.createDataFrame(rows + rows[:5], "g string, name string, loss double"), ["g"], "name", "loss")
    texts = sorted({(g, n) for g, n in found if n})
    want = sorted((g, a, b) for g, a in texts for h, b in texts if g == h and a != b and brute.edit_distance(a, b) <= int(loss * max(len(a), len(b)) + 1e-12))
    assert sorted(map(tuple, got.collect())) == want


def hot(draw, n):
    """Records of one city and one branch: a hot key, with a few misspelt copies in another source."""
    rows = []
    for i, name in enumerate(names(draw, n)):
        rows.append(dict(id=f"r{i:05}", source="epa_echo" if i % 2 else "osha", raw_name=name, raw_address=f"{draw.randrange(9000)} MAIN STREET",
                         raw_city="AUSTIN", raw_state="TX", raw_zip="77001", raw_latitude=None, raw_longitude=None, raw_naics_code="332710", registry_id=None))
    return rows


SCHEMA = "id string, source string, raw_name string, raw_address string, raw_city string, raw_state string, raw_zip string, raw_latitude string, raw_longitude string, raw_naics_code string, registry_id string"


def test_hot_key_equals_brute_force_and_stays_linear(spark):
    met = {}
    for n in (60, 240):
        rows = hot(random.Random(n), n)
        frame = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
        config = MatchConfig(max_block=20)
        found = linkage.match(frame, config)
        got = {tuple(sorted((r.record_a, r.record_b))): r.confidence_score for r in linkage.expand(found).collect()}
        assert got == brute.pairs(rows)
        folds = linkage.fold_by_fields(linkage.prepared(frame, config))
        met[n] = linkage.keyed_pairs(folds, config).count() / len(rows)
    # Pairs that reach the score, for each record: they do not grow with the key, whose pairs would be four times as many.
    assert met[240] < 1.6 * met[60] + 4
    assert linkage.keyed_pairs(folds, MatchConfig(max_block=10**6)).count() > 10 * met[240] * len(rows)


def test_losses_follow_the_configuration():
    losses = linkage.name_losses(MatchConfig())
    assert 0.29 < losses["street"] < 0.32 and 0.07 < losses["zip"] < 0.08 < losses["city"]
    assert linkage.name_losses(MatchConfig(review=20))["street"] > 0.5
