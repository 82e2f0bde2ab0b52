import random

from pyspark.sql import functions as F

from stringmill.operators import templates as ops
from stringmill.plans.labelling import (
    feasible_templates,
    label_generated_templates,
    template_table,
    template_tally,
)

KNOWN = "ord long, id string, split string, product string, template string"
PARTS = ["[C:1]", "[O:2]", "[N:3]", "[S:4]"]


def make(rng, n):
    def one():
        a, b = rng.choice(PARTS), rng.choice(PARTS + [""])
        return f"{a}.{b}>>{rng.choice(PARTS)}"

    return [one() for _ in range(n)]


def key(t):
    import re

    sides = [sorted(s.split(".")) for s in re.sub(r":\d+", "", t).split(">>")]
    return None if any(p == "" for s in sides for p in s) else ">>".join(".".join(s) for s in sides)


def data(seed=1):
    rng = random.Random(seed)
    gen = [(i % 5, i, t) for i, t in enumerate(make(rng, 90))]
    known = [
        (i, rng.choice([f"id{i}", None]), rng.choice(["train", "valid", "test"]), f"P{i % 4}", t)
        for i, t in enumerate(make(rng, 25))
    ]
    return gen, known


def test_similar_rows_and_summary(rows):
    gen, known = data()
    g, k = rows("batch int, ord long, template string", *gen), rows(KNOWN, *known)
    keys = {key(t) for _, _, t in gen}
    found = ops.similar_known(g, k, "canonical")
    assert {r.ord for r in found.collect()} == {o for o, _, _, _, t in known if key(t) in keys}
    summary = {r.key: r for r in ops.matches_summary(found).collect()}
    for name, r in summary.items():
        ids = [i for _, i, _, _, t in known if key(t) == name]
        assert r.n_similar == len(ids)
        assert r.num_works_with == sum(i is not None for i in ids)
        assert r.first_id == next((i for i in ids if i is not None), None)


def rule(template, product):
    if product == "P3":
        raise RuntimeError("no rule for this product")
    return (len(template) + int(product[1])) % 2 == 0


def check_feasibility(rows, applies):
    gen, known = data(2)
    g, k = rows("batch int, ord long, template string", *gen), rows(KNOWN, *known)
    got = {r.template: r for r in ops.feasibility(g, k, applies).collect()}
    assert set(got) == {t for _, _, t in gen if key(t) is not None}

    def works(t, p):
        try:
            return True if applies is None else applies(t, p)
        except RuntimeError:
            return False

    for t, r in got.items():
        hits = [i for _, i, _, p, kt in known if key(kt) == key(t) and works(t, p)]
        ids = [i for i in hits if i is not None]
        assert (r.feasible, r.num_works_with) == (bool(hits), len(ids))
        assert r.first_id == (None if not hits else ids[0] if ids else "")


def test_feasibility_by_key(rows):
    check_feasibility(rows, None)


def test_feasibility_by_rule(rows):
    check_feasibility(rows, rule)


def test_labels_and_tally(rows):
    gen, known = data(3)
    gen += [(5, 900, gen[0][2]), (5, 901, "_^")]
    g, k = rows("batch int, ord long, template string", *gen), rows(KNOWN, *known)
    labelled = label_generated_templates(g, k)
    got = [r.asDict() for r in labelled.collect()]
    distinct = {(b, t.replace("^", "").replace("_", "")) for b, _, t in gen}
    assert len(got) == len(distinct)
    all_texts = [t for _, t in distinct]
    known_keys = {key(t) for *_, t in known}
    splits = {s: {t for _, _, s2, _, t in known if s2 == s} for s in ("train", "valid", "test")}
    for r in got:
        t = r["template"]
        feasible = key(t) is not None and key(t) in known_keys
        assert r["valid"] == (key(t) is not None)
        assert r["unique"] == (all_texts.count(t) == 1)
        assert r["feasible"] == feasible
        assert r["in_val"] == (feasible and t in splits["valid"])
        assert r["in_test"] == (feasible and t in splits["test"])
        assert r["is_known"] == any(t in s for s in splits.values())
    counts = [r["count"] for r in template_tally(labelled).orderBy("idx").collect()]
    valid = {t for t in all_texts if key(t) is not None}
    feasible = {t for t in valid if key(t) in known_keys}
    exact = {t for t in feasible if any(t in s for s in splits.values())}
    assert counts == [
        len(distinct),
        sum(key(t) is not None for _, t in distinct),
        len(valid),
        len(feasible),
        len(exact),
        len(exact & splits["valid"]),
        len(exact & splits["test"]),
    ]
    assert feasible_templates(labelled).count() == len(feasible)
    assert len(template_table(labelled).columns) == 9
    check = ops.partition_check(labelled).first()
    assert check.n_valid == len(valid) and check.feasible_within_valid and check.known_within_feasible
    assert check.valid_is_known_plus_new == (
        len(valid) == len(exact) + len({t for t in valid if not any(t in s for s in splits.values())})
    )


def test_known_by_split(rows):
    _, known = data(4)
    k = rows(KNOWN, *known)
    g = k.select("template").distinct().union(rows("template string", ("nowhere",)))
    flagged = ops.known_by_split(g, k, spread_by="template")
    for r in flagged.collect():
        mine = [s for _, _, s, _, t in known if t == r.template]
        assert (r.is_known, r.in_val, r.in_test) == (bool(mine), "valid" in mine, "test" in mine)
    assert flagged.where(F.col("template") == "nowhere").first().is_known is False
