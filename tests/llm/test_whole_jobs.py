"""Operators on inputs in which what counts lies beyond a first part."""

import random

from srcgraph.llm import html_text, mixing, secrets


def test_mixing_ranks_follow_identifiers_at_every_bucket_size(spark):
    r = random.Random(3)
    rows = [(i * 7 - 900, r.choice(["a", "a", "a", "b", "c", None])) for i in range(500)] + [(None, "a"), (None, "b"), (5, "a"), (5, "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    name = lambda s: s if s in ("a", "b") else "*"
    ids = {s: sorted({-(1 << 63) if i is None else i for i, x in rows if name(x) == s}) for s in ("a", "b", "*")}
    for bucket in (1_000_000, 20, 3):
        out = mixing.mix(df, {"a": 2.0, "b": 1.0, "*": 1.0}, block=8, period=20, bucket_rows=bucket).collect()
        assert len(out) == len(rows)
        for x in out:
            rank = ids[x.mix_source].index(-(1 << 63) if x.doc_id is None else x.doc_id)
            assert (x.mix_block, x.mix_offset) == (rank // 8 + 1, rank % 8)


def test_html_text_goes_on_after_links():
    prose = [f"<p>{f'Sentence {k} of the text. ' * 6}</p>" for k in range(4)]
    links = "<ul><li><a href=1>One thing</a></li><li><a href=2>Two things</a></li><li><a href=3>More</a></li><li><a href=4>Still more</a></li></ul>"
    boxes = "<aside>Buy</aside>" * 3
    page = f"<html><body><nav>Home</nav>{links}{prose[0]}{links}<p>A short line.</p>{boxes}{prose[1]}{prose[2]}{boxes}{prose[3]}{links}<footer>foot</footer></body></html>"
    want = [prose[0], "<p>A short line.</p>", *prose[1:]]
    assert html_text.main_text(page) == "\n\n".join(p[3:-4].strip() for p in want)
    assert html_text.main_text(f"<p>Few.</p>{links}<p>Words.</p>") == "Few.\n\nWords."


def test_secrets_joined_to_ordinary_words(spark):
    from pyspark.sql import functions as F

    model = secrets.fit(secrets.training_samples(spark))
    r = random.Random(5)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    heads = ["aws_secret_access_key=", "config/user/", "src/components/user/list/", "get_user_name_from_the_list_of_all_users/path/"]
    cases = [(h, key(n), t) for h in heads for n in (20, 32, 40) for t in ("", "/read/the/next/line/of/file")]
    rows = [(i, f"see {h}{k}{t} here") for i, (h, k, t) in enumerate(cases)] + [(100, f"{heads[0]}{key(40)}/list/of/user/values/and/names/{key(40)}/file")]
    got = {x.doc_id: [(s.start, s.stop) for s in x.secrets] for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    found = [any(a <= 4 + len(h) and 4 + len(h) + len(k) <= b for a, b in got[i]) for i, (h, k, _) in enumerate(cases)]
    assert all(found), [cases[i] for i, x in enumerate(found) if not x]
    assert len(got[100]) >= 2
    plain = secrets.training_samples(spark, 3000).where(F.length("text") >= 20).where("label = 0").select("text")
    share = secrets.scan(plain, model).select(F.avg((F.size("secrets") > 0).cast("double"))).first()[0]
    assert share < 0.01, share


def test_lines_join_alike_at_every_size(spark):
    """The lists of removed lines are merged with the documents, not broadcast while they are few."""
    from srcgraph.llm import line_dedup

    docs = spark.createDataFrame([(i, "a\nb\nc\n" + str(i)) for i in range(20)], "doc_id long, text string")
    out = line_dedup.dedup_lines(docs)
    plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r.doc_id, r.n_removed) for r in out.collect()) == [(0, 0)] + [(i, 3) for i in range(1, 20)]
