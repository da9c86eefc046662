import re

import duckdb

from tessera.llm import licenses

MIT = licenses.TEMPLATES[14][1]


def brute(text):
    body = text or ""
    units = body.split("\n") + [p for p in re.split("\n[ \t\r]*\n", body) if "\n" in p]
    hits = []
    for u in units:
        g = set(licenses.bigrams(re.sub("[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in u)).split()))
        scored = [(2 * len(g & set(b)) / (len(g) + len(b)), -i, name) for i, (name, t) in enumerate(licenses.TEMPLATES) if (b := licenses.bigrams(licenses.normalise(t)))]
        if g and max(scored)[0] >= 0.8:
            hits.append(max(scored))
    return len(hits), ",".join(sorted({h[2] for h in hits})), max(hits)[2] if hits else None, round(max(hits)[0], 6) if hits else None


TEXTS = [
    None, "", "one", "Released under the MIT License.", "intro\n\nReleased  under the MIT licence!\nreleased under the mit license", MIT, "x\n\n" + MIT.replace(" to deal", "\nto deal").replace(" use,", "\nuse,") + "\n\nmore",
    "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "licensed under the apache license, version 2.0. " * 3, "the of and " * 50_000, "ÉLicensed under the Apache License, Version 2.0é",
    "This work is licensed under the GNU General Public License, version 2.", "a b",
]


def test_brute_force_and_sql(spark):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], 1), (3, TEXTS[3], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_hits int")
    got = sorted(map(tuple, licenses.scan_table(df).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    assert sorted(duckdb.sql(licenses.oracle_sql()).fetchall(), key=str) == got
    assert licenses.scan_table(df.limit(0)).count() == 0


def test_no_python(spark):
    plan = licenses.scan_table(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
