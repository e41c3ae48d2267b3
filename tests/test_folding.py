"""Constant folding against a plain recursive evaluation."""

import random

import pytest

from loomgraph.operators import folding

SCHEMA = "id long, op string, text string, parent long, position int, after string, declared string, of long, is_const boolean, value string, category string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "v", "c") for r in rows], SCHEMA).repartition(3)


def plain(rows, steps):
    by_id, parts = {r[0]: r for r in rows}, {}
    for r in rows:
        if r[3] is not None:
            parts.setdefault(r[3], []).append((r[4], r[0]))

    def of(i, left):
        if left <= 0:
            return None, folding.TOO_LONG, i
        if i not in by_id:
            return None, folding.RUNTIME, i
        _, op, text, _, _, _, declared, init, const = by_id[i]
        if op in ("string", "number"):
            return text or "", None, i
        if op in ("import", "env"):
            return None, folding.DYNAMIC_IMPORT if op == "import" else folding.BASE_URL, i
        if op == "plus":
            values = []
            for _, p in sorted(parts.get(i, [])):
                value, category, cause = of(p, left - 1)
                if category:
                    return value, category, cause
                values.append(value)
            return ("".join(values), None, i) if values else (None, folding.RUNTIME, i)
        variable = op in ("name", "property") and declared == "variable"
        if init is not None and (variable or (op == "property" and declared == "property")):
            if not const:
                return None, folding.NOT_CONSTANT, i
            if variable and init in by_id and by_id[init][1] == "import":
                return None, folding.DYNAMIC_IMPORT, i
            return of(init, left - 1)
        return None, folding.RUNTIME, i

    def call(i):
        if i in by_id and by_id[i][1] == "template":
            out, holed = by_id[i][2] or "", False
            held = [p for _, p in sorted(parts.get(i, []))]
            for p in held:
                value, category, cause = of(p, steps)
                if category not in (None, folding.RUNTIME):
                    return None, None, category, cause
                out, holed = out + ("{*}" if category else value) + (by_id[p][5] or ""), holed or bool(category)
            return out, folding.WITH_HOLES if holed else folding.FOLDED if held else folding.LITERAL, None, None
        value, category, cause = of(i, steps)
        if category:
            return None, None, category, cause
        return value, folding.LITERAL if by_id[i][1] == "string" else folding.CONSTANT, None, None

    folded = {i: of(i, steps) for i in by_id}
    return {i: (v, c, cause if c else i) for i, (v, c, cause) in folded.items()}, {i: call(i) for i in [*by_id, 10**6]}


def forest(seed, n=300):
    """Sums, names and properties that lead to any other expression, so that values are shared, deep or run in circles."""
    r = random.Random(seed)
    rows = []
    free = list(range(n))
    r.shuffle(free)
    inside = {}
    for i in free[: n // 5]:
        for position in range(2 if r.random() < 0.9 else r.randint(0, 4)):
            part = r.randrange(n)
            if part != i and part not in inside:
                inside[part] = (i, position)
    sums = set(free[: n // 5])
    for i in range(n):
        parent, position = inside.get(i, (None, None))
        if i in sums:
            op = r.choice(["plus", "plus", "plus", "template"])
            rows.append((i, op, "/h" if op == "template" else None, parent, position, r.choice([None, "/"]), None, None, None))
            continue
        op = r.choices(["string", "number", "name", "property", "template", "import", "env", "other"], [30, 5, 25, 20, 3, 2, 2, 4])[0]
        declared = r.choice(["variable", "property", None]) if r.random() < 0.4 else "variable"
        leads = op in ("name", "property")
        rows.append((i, op, r.choice(["a", "/b", "", None]) if op in ("string", "number", "template") else None, parent, position, r.choice([None, "/"]), declared if leads else None, r.choice([r.randrange(n), r.randrange(n), n + 5]) if leads and r.random() < 0.95 else None, r.random() < 0.9 if leads else None))
    return rows


@pytest.mark.parametrize("seed, steps", [(1, 8), (2, 8), (3, 3), (4, 1), (5, 20)])
def test_folding_equals_plain_evaluation(spark, seed, steps):
    rows = forest(seed)
    values, calls = plain(rows, steps)
    df = table(spark, rows)
    got = {r.id: (r.value, r.category, r.cause) for r in folding.resolved(df, steps).collect()}
    assert got == values
    asked = spark.createDataFrame([(i, i) for i in calls], "call long, id long")
    assert {r.call: (r.template, r.tier, r.category, r.cause) for r in folding.folded(asked, df, steps).collect()} == calls


def test_no_expressions_and_repeated_rows(spark):
    assert folding.resolved(table(spark, [])).collect() == []
    row = (1, "string", "a", None, None, None, None, None, None)
    got = folding.folded(spark.createDataFrame([(7, 1), (8, 1), (9, None)], "call long, id long"), table(spark, [row, row])).collect()
    assert sorted((r.call, r.template, r.tier, r.category) for r in got) == [(7, "a", "literal", None), (8, "a", "literal", None), (9, None, None, folding.RUNTIME)]
