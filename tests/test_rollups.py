import datetime as dt
import random

from pyspark.sql import functions as F

from codeloom.operators import rollups as RU
from codeloom.operators import tenancy as TN

SCAN = "scan_id long, project_id string, status string, created_at timestamp_ntz"
FINDING = "finding_id long, project_id string, severity string, status string, created_at timestamp_ntz, fixed_at timestamp_ntz"
START = dt.datetime(2024, 1, 1)


def test_batches_in_any_order_equal_the_whole_table(spark, tmp_path):
    r = random.Random(2)
    projects = ["a", "b", "c", None, "empty"]
    scans, findings, batches, key = {}, {}, [], 0
    for step in range(4):
        added, removed = ([], []), ([], [])
        for _ in range(60):
            key += 1
            at = None if r.random() < 0.05 else START + dt.timedelta(hours=r.randrange(24 * 20))
            kind, table = (0, scans) if r.random() < 0.5 else (1, findings)
            row = (key, r.choice(projects[:4]), "queued", at) if kind == 0 else (key, r.choice(projects[:4]), r.choice([*TN.SEVERITIES, None]), "open", at, None)
            table[key] = row
            added[kind].append(row)
            if step and r.random() < 0.6 and len(table) > 5:
                old = r.choice(sorted(k for k in table if k not in {x[0] for x in added[kind]}) or [None])
                if old is None or any(x[0] == old for x in removed[kind]):
                    continue
                row = table.pop(old)
                removed[kind].append(row)
                if r.random() < 0.5:  # an update: the old version goes, the new one comes
                    row = (*row[:2], "done", row[3]) if kind == 0 else (*row[:3], "fixed", row[4], START + dt.timedelta(days=r.randrange(20)))
                    table[old] = row
                    added[kind].append(row)
        batches.append((added, removed))
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    order = list(enumerate(batches))
    r.shuffle(order)
    for n, (added, removed) in order + order[:1]:  # the last one is a batch tried again
        s, f = [RU.signed(make(added[i], x), make(removed[i], x)) for i, x in enumerate((SCAN, FINDING))]
        RU.store_batch(RU.day_states(s, f), str(tmp_path), n)
    states = RU.merged(RU.stored(spark, str(tmp_path)))
    now_scans, now_findings = make(list(scans.values()), SCAN), make(list(findings.values()), FINDING)
    owners = make([(p,) for p in projects], "project_id string")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(RU.project_stats(owners, states, now_scans)) == rows(TN.project_stats(owners, now_scans, now_findings))
    first, last = F.expr("DATE '2024-01-01'"), F.expr("DATE '2024-01-25'")
    assert rows(RU.daily_trend(states, first, last)) == rows(TN.daily_trend(now_scans, now_findings, first, last))
    t, c = RU.totals(states).first(), TN.finding_counts(now_findings).first()
    assert (t.scans, t.findings, t.open, t.fixed, t.critical, t.low) == (len(scans), c.total, c.open, c.fixed, c.critical, c.low)


def test_distinct_values_go_with_their_last_row(spark):
    make = lambda rows: spark.createDataFrame(rows, "cve string, file string")
    one = RU.value_states(RU.signed(make([("x", "f"), ("x", "g"), ("y", None), (None, "g")])), ["cve", "file"])
    two = RU.value_states(RU.signed(make([("z", "f")]), make([("x", "f"), ("y", None)])), ["cve", "file"])
    found = RU.cardinalities(RU.merged_values(two, one)).collect()
    assert {r["column"]: r["distinct"] for r in found} == {"cve": 2, "file": 2}
    assert RU.totals(RU.merged(RU.day_states(*[RU.signed(spark.createDataFrame([], x)) for x in (SCAN, FINDING)]))).first().scans == 0
