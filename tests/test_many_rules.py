"""The literal index against plain predicates; blocks of time against windows; imports and stored risk."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from vigilake.operators.blocks import evidence_in_blocks, ordered_chain_in_blocks, threshold_in_blocks, unordered_chain_in_blocks
from vigilake.operators.correlation import ordered_chain, unordered_chain
from vigilake.operators.windows import threshold, threshold_evidence
from vigilake.plans.detect import Risk, rule_alerts, stored_leaderboard
from vigilake.plans.literals import guard_of, indexed_hits, trie_pattern
from vigilake.plans.rules import Rule, load_rules
from vigilake.plans.sigma import import_document
from vigilake.sources.parsers import parse
from vigilake.sources.sinks import append_alerts, read_alerts


def test_trie_takes_the_longest():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab.*(é") for _ in range(rng.randrange(1, 6))) for _ in range(80)})
    pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), trie_pattern(words))
    for _ in range(500):
        text = "".join(rng.choice("ab.*(éz") for _ in range(8))
        found = re.match(pattern, text)
        assert (found[0] if found else None) == max((w for w in words if text.startswith(w)), key=len, default=None)


def test_index_agrees_with_plain_predicates(spark):
    rng = random.Random(2)
    urls = ["/" + "".join(rng.choice("abcAB./%é") for _ in range(rng.randrange(0, 14))) for _ in range(300)] + ["/uploads/x.php", "/a?id=1' or 1=1"]
    lines = [f'1.2.3.4 - - [01/Mar/2024:10:00:00 +0000] "GET {u} HTTP/1.1" 200 5 "-" "agent {k % 7}"' for k, u in enumerate(urls)]
    events = parse("access.log", spark.createDataFrame(list(enumerate(lines)), "ingest_seq long, value string"), 2024)
    word = lambda: "".join(rng.choice("abc./%é") for _ in range(rng.randrange(1, 5)))
    many = [Rule(id=f"w{k}", title="t", selections={"s": {"url.original|contains": [word() for _ in range(1 + k % 4)]}}, condition="s") for k in range(150)]
    many += [Rule(id=f"p{k}", title="t", selections={"s": {"url.original|contains": word(), "user_agent.original|contains": f"AGENT {k % 9}"}}, condition="s", logsource={"category": "web" if k % 2 else "process"}) for k in range(30)]
    many += [Rule(id=f"n{k}", title="t", selections={"s": {"url.original|contains": word()}, "f": {"url.original|endswith": "a"}}, condition="s and not f") for k in range(10)]
    many += [Rule(id=f"c{k}", title="t", selections={"s": {"url.original|contains": word()}}, condition="s | count() by source.ip >= 2", logsource={"category": "web", "service": "ssh" if k else ""}) for k in range(2)]
    many += [r for r in load_rules()[0]]
    got = {tuple(r) for r in indexed_hits(events, many).collect()}
    marks = events.select("ingest_seq", F.array_compact(F.array(*(F.when(r.predicate(), F.lit(r.id)) for r in many))).alias("r"))
    assert got == {(r["ingest_seq"], x) for r in marks.collect() for x in r["r"]} and len(got) > 500
    assert guard_of(many[0]).whole and not guard_of(many[150]).whole and guard_of(many[180]) is None
    assert indexed_hits(events.limit(0), many).count() == 0


@pytest.mark.parametrize("op", [">=", "==", "<"])
def test_blocks_agree_with_windows(spark, op):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "u"]), rng.randrange(300), k) for k in range(400)]
    frame = spark.createDataFrame([(k, None if k == "u" or n % 17 == 0 else n, i) for k, n, i in rows], "k string, n long, seq long")
    frame = frame.withColumn("ts", F.timestamp_seconds(F.col("n") * 10)).repartition(6)
    for keys in ([], ["k"]):
        plain = threshold(frame.withColumn("all", F.lit(1)), keys or ["all"], "ts", "seq", 200_000_000, op, 7).drop("all")
        mine = threshold_in_blocks(frame, keys, "ts", "seq", 200_000_000, op, 7)
        assert sorted(map(str, mine.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        cols = [*keys, "seq", "match_count", "evidence_rank"]
        plain = threshold_evidence(frame, keys, "ts", "seq", 200_000_000, op, 7).select(*cols)
        assert sorted(map(str, evidence_in_blocks(frame, keys, "ts", "seq", 200_000_000, op, 7).select(*cols).collect())) == sorted(map(str, plain.collect()))
    plan = threshold_in_blocks(frame, [], "ts", "seq", 200_000_000, op, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "SinglePartition" not in plan.split("Window")[1]


def test_chains_without_keys_agree(spark):
    rng = random.Random(9)
    for n in (0, 3, 200):
        rows = [(rng.randrange(400), rng.choice("abcd"), k) for k in range(n)]
        frame = spark.createDataFrame(rows, "n long, rule_id string, seq long").withColumn("ts", F.timestamp_seconds("n")).repartition(5)
        keyed = frame.withColumn("all", F.lit(1))
        for span in (2_000_000, 30_000_000, 500_000_000):
            assert ordered_chain_in_blocks(frame, ["c", "a", "b"], span).collect() == ordered_chain(keyed, ["all"], ["c", "a", "b"], span).drop("all").collect()
            assert unordered_chain_in_blocks(frame, ["c", "a", "b"], span).collect() == unordered_chain(keyed, ["all"], ["c", "a", "b"], span).drop("all").collect()


def test_import_names_fields_it_has_no_place_for():
    doc = {"id": "x", "title": "X", "detection": {"s": [{"CommandLine|contains": "a", "Hashes|contains": "MD5"}, {"GrantedAccess": "0x1"}], "condition": "s"}}
    found = import_document(doc)
    assert found.rule and found.unmapped == ("GrantedAccess", "Hashes")
    assert import_document({"id": "x", "title": "X", "detection": {"s": {"Image": "a"}, "condition": "s"}}).unmapped == ()


def test_import_of_yaml(tmp_path):
    yaml = pytest.importorskip("yaml")
    from vigilake.plans.sigma import import_folder

    (tmp_path / "a.yml").write_text(yaml.safe_dump({"id": "y", "title": "Y", "detection": {"s": {"Image|endswith": "cmd.exe"}, "condition": "s"}}))
    assert import_folder(tmp_path)[0].rule.id == "y"


def test_leaderboard_over_a_store(spark, tmp_path):
    lines = [f"Mar  1 10:0{k}:00 h sshd[7]: Failed password for u{k % 2} from 61.4.88.{k % 3} port 4000 ssh2" for k in range(6)]
    events = parse("auth.log", spark.createDataFrame(list(enumerate(lines)), "ingest_seq long, value string"), 2024)
    rules = [Rule(id="b", title="b", selections={"s": {"event.action": "ssh_login_failed"}}, condition="s", level="high")]
    path = str(tmp_path / "store")
    append_alerts(rule_alerts(events, rules).drop("scope"), path)
    rows = stored_leaderboard(read_alerts(spark, path), Risk(threshold=150), 3).collect()
    assert [(r["field"], r["entity"], r["score"], r["signals"], r["over_threshold"]) for r in rows] == [("user.name", "u0", 180, 3, True), ("user.name", "u1", 180, 3, True), ("source.ip", "61.4.88.0", 120, 2, False)]
    assert stored_leaderboard(read_alerts(spark, str(tmp_path / "none")), Risk()).count() == 0 and json.dumps(rows[0].asDict())
