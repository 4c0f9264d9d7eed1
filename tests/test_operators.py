import hashlib
import random
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import calendars
from ledgerloom.operators import arrivals, attribution, audit, board, mapping, projection, recon, scoring, slots, valuedate
from ledgerloom.schema import CANONICAL, COMPARED

SIDE = "account_id string, instrument_id string, trade_id string, row_idx int, quantity decimal(28,8), trade_price decimal(28,8), settlement_price decimal(28,8), gross_amount decimal(28,8), net_amount decimal(28,8), market_value decimal(28,8), currency string"


def side(spark, rows):
    full = [(a, "I", t, i, q, None, s, None, None, None, c) for i, (a, t, q, s, c) in enumerate(rows)]
    return recon.last_per_key(recon.with_key(spark.createDataFrame(full, SIDE)), ["row_idx"])


def test_breaks(spark):
    D = Decimal
    a = side(spark, [("A", "1", D(5), D(0), "USD"), ("A", "1", D(7), D(0), "USD"), ("A", "2", D("1.005"), None, None), (None, "3", D(1), None, "EUR"), ("A", "4", None, None, None)])
    b = side(spark, [("A", "1", D(7), None, "USD"), ("A", "2", D("1.01"), None, None), ("A", "5", D(1), None, "EUR"), ("A", "4", D(0), None, None)])
    got = {(r.kind, r.join_key, r.field_name): (r.side_1_value, r.side_2_value) for r in recon.breaks(a, b).collect()}
    assert set(got) == {
        ("MISSING_SIDE_2", "|I|3", ""), ("MISSING_SIDE_1", "A|I|5", ""), ("VALUE_MISMATCH", "A|I|1", "settlement_price"), ("VALUE_MISMATCH", "A|I|4", "quantity"),
    }
    assert got["VALUE_MISMATCH", "A|I|4", "quantity"][0] == "" and Decimal(got["VALUE_MISMATCH", "A|I|4", "quantity"][1]) == 0
    assert recon.matched(a, b).first().matched == 3 and recon.missing_sides(a, b).count() == 2
    assert len(COMPARED) == 7 and recon.report(recon.breaks(a, b), 2).select("break_count", F.size("breaks")).first()[:] == (4, 2)


def test_verdicts_follow_a_sequential_history(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.choice("xy")) for i in range(60)]
    known, want = {}, {}
    for i, digest, name in rows:
        want[i] = "NEW" if digest not in known else "DUPLICATE" if known[digest] == name else "REDELIVERY"
        known.setdefault(digest, name)
    df = spark.createDataFrame(rows, "i int, digest string, name string")
    assert {r.i: r.verdict for r in arrivals.dedupe_verdicts(df, "digest", "name", ["i"]).collect()} == want


def test_quiescence(spark):
    scans = {"a": [(1, 5), (2, 5), (3, 6), (4, 6), (5, 6), (6, 6)], "b": [(1, 1), (3, 1), (4, 1), (5, 1)], "c": [(1, 2), (2, 2)], "d": [(1, 1), (2, 1), (3, 1), (4, 1), (6, 1), (7, 1), (8, 1)]}
    rows = [(p, s, z, p == "c") for p, v in scans.items() for s, z in v]
    df = spark.createDataFrame(rows, "path string, seq int, size int, mark boolean")
    got = sorted((r.path, r.seq) for r in arrivals.quiescent(df, "path", "seq", ["size"], 2, 4, "mark").collect())
    assert got == [("a", 5), ("b", 5), ("c", 2), ("d", 3), ("d", 8)]


def test_queue(spark):
    good = '{"messageId": "m/1", "source": "S", "payload": {"k": 1}}'
    df = spark.createDataFrame([("t", 0, 1, good), ("t", 0, 2, "{bad"), ("t", 3, 9, '{"x": 1}')], "topic string, partition int, offset int, value string")
    ok, bad = arrivals.queue_arrivals(df)
    assert sorted(r.name for r in ok.collect()) == ["S_m_1.json", "t_p3_o9.json"] and bad.count() == 1


def records(n=5):
    return [(f"r{i}", f"a{i % 2}", f"2026-08-31T06:0{i}:00Z", "c", "D", "{}", '{"x":1}', "system") for i in range(n)]


def test_chain(spark):
    shape = "record_id string, arrival_id string, at string, component string, decision_type string, inputs_json string, outcome_json string, actor string"
    df = spark.createDataFrame(records(), shape)
    chain = audit.chain_links(df).select("arrival_id", "record_id", "prev_hash", "record_hash")
    want, prev = {}, {}
    for r in records():
        text = "".join(f"{x}\x1f" for x in (*r, prev.get(r[1], "")))
        want[r[0]] = prev[r[1]] = hashlib.sha256(text.encode()).hexdigest()
    assert {r.record_id: r.record_hash for r in chain.collect()} == want
    stored = df.join(chain, ["arrival_id", "record_id"])
    assert audit.verify(stored).count() == 0 and {r.record_hash for r in audit.previous_hash(stored).collect()} == set(prev.values())
    edited = stored.withColumn("actor", F.when(F.col("record_id") == "r2", "me").otherwise("system"))
    assert [(r.arrival_id, r.position, r.reason) for r in audit.verify(edited).collect()] == [("a0", 2, "content")]
    assert [(r.arrival_id, r.position, r.reason) for r in audit.verify(stored.where("record_id != 'r1'")).collect()] == [("a1", 1, "link")]
    every = {r.arrival_id: (r.records, r.position, r.reason) for r in audit.verify_all(edited).collect()}
    assert every["a0"][1:] == (2, "content") and every["a1"][1:] == (None, None) and sum(n for n, *_ in every.values()) == len(want)


def test_chains_grow_batch_by_batch_and_replays_add_nothing(spark, tmp_path):
    shape = "record_id string, arrival_id string, at string, component string, decision_type string, inputs_json string, outcome_json string, actor string"
    rows = [(f"r{i:02}", f"a{i % 3}", f"2026-01-01T00:00:{i:02}Z", "c", "T", "{}", "{}", "system") for i in range(30)]
    spark.createDataFrame([], shape + ", prev_hash string, record_hash string").write.parquet(f"{tmp_path}/s")
    stored = lambda: spark.read.parquet(f"{tmp_path}/s")
    for low, high in ((0, 10), (5, 20), (5, 20), (18, 30)):
        linked, late = audit.extend(stored(), spark.createDataFrame(rows[low:high] + rows[low : low + 2], shape))
        assert late.count() == 0
        linked.write.mode("append").parquet(f"{tmp_path}/s")
    whole = {r.record_id: (r.prev_hash, r.record_hash) for r in audit.chain_links(spark.createDataFrame(rows, shape)).collect()}
    assert {r.record_id: (r.prev_hash, r.record_hash) for r in stored().collect()} == whole and stored().count() == 30
    old = ("r00x", "a0", "2026-01-01T00:00:01Z", "c", "T", "{}", "{}", "system")
    linked, late = audit.extend(stored(), spark.createDataFrame([old], shape))
    assert linked.count() == 0 and [r.record_id for r in late.collect()] == ["r00x"]


def test_links_of_a_long_chain(spark):
    shape = "record_id string, arrival_id string, at string, component string, decision_type string, inputs_json string, outcome_json string, actor string"
    rows = [(f"r{i:06d}", "hot" if i % 10 else f"a{i}", "2026-08-31T06:00:00Z", "c", "D", "{}", None, "system") for i in range(30_000)] + records()
    want, last = {}, {}
    for r in sorted(rows):
        text = "".join(f"{x or ''}\x1f" for x in (*r, last.get(r[1], "")))
        prev, last[r[1]] = last.get(r[1], ""), hashlib.sha256(text.encode()).hexdigest()
        want[r[0]] = (r[1], prev, last[r[1]])
    got = audit.chain_links(spark.createDataFrame(rows, shape).repartition(5)).collect()
    assert len(got) == len(rows) and {r.record_id: (r.arrival_id, r.prev_hash, r.record_hash) for r in got} == want


def simulate(rows):
    state, out = {}, {}
    for seq, key, s in rows:
        one, two, asg = state.get(key, (None, None, None))
        one, two = (f"{seq}", two) if s == slots.GL else (one, f"{seq}")
        done = one and two
        out[seq] = (one, two, "ASSIGNED" if done else "PARTIAL", f"asg-{seq}" if done else None, asg if done else None)
        state[key] = (one, two, f"asg-{seq}" if done else asg)
    return out


def slot_rows(n=60, seed=5):
    rng = random.Random(seed)
    return [(i, rng.choice("ABC"), rng.choice([slots.GL, slots.CLIENT])) for i in range(n)]


def slot_frame(spark, rows):
    df = spark.createDataFrame([(i, k, s, str(i)) for i, k, s in rows], "seq long, client_id string, side string, arrival_id string")
    return df.withColumns({"domain": F.lit("TRADE"), "value_date": F.lit("2026-08-28").cast("date")})


def test_slots_follow_a_sequential_machine(spark):
    out = slots.fold(slot_frame(spark, slot_rows()))
    got = {r.seq: (r.side_1, r.side_2, r.state, r.assignment_id, r.supersedes) for r in out.collect()}
    want = simulate(slot_rows())
    assert got == want
    assert slots.voids(out).count() == sum(v[4] is not None for v in want.values()) and slots.current(out).count() == 3


def test_window_and_deadline(spark):
    days = calendars.calendar_days(spark, {"X": [("2026-08-31", "h")]}, "2026-08-01", "2026-09-30")
    df = spark.createDataFrame([(date(2026, 8, d), "X") for d in range(24, 32)] + [(date(2026, 9, 2), "X"), (date(2026, 9, 3), "X")], "value_date date, calendar_id string")
    got = {r.value_date.day for r in slots.accepted(df, days, "2026-08-28", 2).where("accepted").collect()}
    assert got == {26, 27, 28, 29, 30, 31, 2} - {2} | ({1, 2} & {d.day for d in [date(2026, 9, 2)]})
    due = {r.value_date.day: str(r.deadline) for r in slots.deadlines(df.where("value_date = '2026-08-28'"), days, 2).collect()}
    assert due == {28: "2026-09-02 23:59:00"}


def test_attribution(spark):
    files = spark.createDataFrame([("1", "MCP_TRD_x.csv"), ("2", "MCP_TRD_y.csv"), ("3", "other"), ("4", "other"), ("5", "MCP_x"), ("6", "zz")], "arrival_id string, name string")
    patterns = spark.createDataFrame([("C1", 0, "MCP_TRD", "TRADE"), ("C1", 1, "MCP", "CASH")], "client_id string, hint_no int, pattern string, domain string")
    accounts = spark.createDataFrame([("a1", "C1"), ("a2", "C2")], "account_id string, client_id string")
    cells = spark.createDataFrame([("1", "a1"), ("2", "a2"), ("3", "a2"), ("4", "a1"), ("4", "a2"), ("6", "?")], "arrival_id string, account_id string")
    got = {r.arrival_id: (r.client_id, r.confidence, r.conflict, r.domain) for r in attribution.attribute(files, cells, patterns, accounts).collect()}
    assert got == {
        "1": ("C1", 0.99, False, "TRADE"), "2": ("C2", 0.45, True, "TRADE"), "3": ("C2", 0.95, False, "UNKNOWN"),
        "4": (None, 0.45, True, "UNKNOWN"), "5": ("C1", 0.80, False, "CASH"), "6": (None, 0.0, False, "UNKNOWN"),
    }
    expected = spark.createDataFrame([("C2", "POSITION"), ("C1", "TRADE"), ("C1", "CASH")], "client_id string, domain string")
    assert {r.arrival_id: r.domain for r in attribution.infer_domain(attribution.attribute(files, cells, patterns, accounts), expected).collect()}["3"] == "POSITION"


def test_value_dates(spark):
    days = calendars.calendar_days(spark, {"X": []}, "2026-08-01", "2026-09-30")
    d = lambda n, m=8: date(2026, m, n)
    files = spark.createDataFrame([(k, "X", f, d(31)) for k, f in (("a", d(31)), ("b", None), ("c", d(29)), ("d", None))], "arrival_id string, calendar_id string, file_date date, arrival_day date")
    cells = spark.createDataFrame([("a", 0, d(27)), ("a", 1, d(28)), ("a", 2, d(28)), ("a", 3, d(27))], "arrival_id string, row_idx int, d date")
    trades = spark.createDataFrame([("b", 0, d(28))], "arrival_id string, row_idx int, d date")
    got = {r.arrival_id: (r.value_date, r.method, r.confidence, r.mismatch) for r in valuedate.resolve(files, cells, trades, days).collect()}
    assert got == {
        "a": (d(27), "CONTENT_EXPLICIT", 0.873, True), "b": (d(31), "CONTENT_INFERRED", 0.85, False),
        "c": (d(28), "FILENAME", 0.6, True), "d": (d(28), "ARRIVAL_MINUS_CALENDAR", 0.55, False),
    }
    split = valuedate.split_batches(cells.union(spark.createDataFrame([("a", 4, None), ("z", 0, None)], cells.schema)))
    assert sorted((r.arrival_id, r.row_idx, r.batch_no) for r in split.collect()) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 1), ("a", 3, 0), ("z", 0, 0)]


def test_score_and_route(spark):
    files = spark.createDataFrame([("1", "CASH"), ("2", "CASH"), ("3", "UNKNOWN")], "arrival_id string, domain string")
    maps = spark.createDataFrame([("1", f, 1.0) for f in ("account_id", "net_amount", "currency")] + [("2", "net_amount", 0.5)], "arrival_id string, field string, confidence double")
    got = {r.arrival_id: (r.coverage, r.missing) for r in scoring.coverage(files, maps).collect()}
    assert got == {"1": (1.0, []), "2": (0.2143, ["account_id", "currency"]), "3": (1.0, [])}
    rows = [(0.9, "c", 0), (0.9, None, 0), (0.2, None, 0), (0.9, "c", 1), (0.7, "c", 0), (0.5, "c", 0)]
    df = spark.createDataFrame(rows, "s double, c string, m int")
    assert [r.r for r in df.select(scoring.route(F.col("s"), F.col("c"), F.lit("d"), F.col("m")).alias("r")).collect()] == ["DISPATCHED", "QUARANTINED", "REJECTED", "QUARANTINED", "QUARANTINED", "REJECTED"]
    case = spark.createDataFrame([("c", False, "2026-08-28", True, 0.6, "QUARANTINED", ["side"]), ("c", False, "d", True, 0.9, "DISPATCHED", [])], "client_id string, conflict boolean, value_date string, mismatch boolean, date_confidence double, disposition string, missing array<string>")
    assert [len(r.reasons) for r in scoring.reasons(case).collect()] == [3, 1]


def test_mapping(spark):
    aliases = spark.createDataFrame([("netamount", "net_amount"), ("qty", "quantity")], "alias string, field string")
    cols = spark.createDataFrame([("1", 0, "Net Amount (USD)"), ("1", 1, "net_amount"), ("1", 2, "Qty"), ("1", 3, "?")], "arrival_id string, col_idx int, header string")
    got = {r.col_idx: (r.field, r.tier) for r in mapping.first_claims(mapping.alias_fields(cols, aliases)).collect()}
    assert got == {0: ("net_amount", "ALIAS"), 1: (None, "UNRESOLVED"), 2: ("quantity", "ALIAS"), 3: (None, "UNRESOLVED")}
    cells = spark.createDataFrame([("f", "I1", 1.0), ("f", "I1", 2.0), ("f", "I2", 3.0), ("f", "I2", 3.0), ("g", "I1", 1.0), ("g", "I2", 1.0)], "a string, i string, v double")
    ratio = mapping.variation_ratio(cells, "i", "v", ["a"])
    assert {r.a: r.ratio for r in ratio.collect()} == {"f": 0.5, "g": 0.5}
    assert {r.field for r in mapping.settle_or_trade(ratio).collect()} == {"trade_price"}
    fuzzy = mapping.fuzzy_fields(spark.createDataFrame([("Net Amnt",), ("zzz",)], "header string"), [("netamount", "net_amount"), ("qty", "quantity")]).collect()
    assert [(r.header, r.field) for r in fuzzy] == [("Net Amnt", "net_amount")]


def test_projection(spark):
    rows = spark.createDataFrame([("a", "C", "2026-08-28", "TRADE", "CME", {"Qty": "(5)", "Acct": "X1", "N": " "}, {"quantity": "Qty", "account_id": "Acct", "net_amount": "N", "client_id": "Acct"})], "arrival_id string, client_id string, value_date string, domain string, source_system string, cells map<string,string>, mapping map<string,string>")
    names = spark.createDataFrame([("X1", "Main")], "account_id string, account_name string")
    out = projection.project(rows, names)
    assert [f.dataType for f in out.schema] == [f.dataType for f in CANONICAL]
    r = out.first()
    assert (r.client_id, r.quantity, r.net_amount, r.account_name, r.side) == ("C", Decimal(-5), None, "Main", None)


def test_board(spark):
    assert [board.list_limit(n) for n in (0, 5, 1000, 1001, -1)] == [200, 5, 1000, 200, 200]
    df = spark.createDataFrame([("1", "QUARANTINED", None), ("2", "REJECTED", 5), ("3", "QUARANTINED", 3), ("4", "DISPATCHED", 1)], "arrival_id string, disposition string, classified_at int")
    reviews = spark.createDataFrame([("2",)], "arrival_id string")
    assert [r.arrival_id for r in board.review_queue(df, reviews).collect()] == ["3", "1"]
    up = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, "b")], "k string, n int, x string, y string")
    assert board.coalesce_upsert(up, ["k"], "n", ["x", "y"]).first()[:] == ("k", "a", "b")
    assert board.first_wins(up, "k", F.col("n")).first().x == "a"
    clear = spark.createDataFrame([(0, 0, 0, 0, 0.0)], "open_alerts int, quarantined int, rejected int, mismatches int, quarantine_rate double")
    assert board.posture(clear).first().level == "CLEAR"


def test_chains_are_extended_in_one_shuffle(spark, capsys):
    shape = "record_id string, arrival_id string, at string, component string, decision_type string, inputs_json string, outcome_json string, actor string"
    rows = [(f"{i:03}", f"a{i % 3}", f"2026-01-01T00:00:{i:02}Z", "c", "d", f"{{{i}}}", "{}", "s") for i in range(30)]
    empty = spark.createDataFrame([], shape + ", prev_hash string, record_hash string")
    whole = {r.record_id: (r.prev_hash, r.record_hash) for r in audit.chain_links(spark.createDataFrame(rows, shape)).collect()}
    first = audit.extend(empty, spark.createDataFrame(rows[:12], shape))[0].collect()
    stored = spark.createDataFrame(first, empty.select(*first[0].__fields__).schema)
    twice = [("012", *rows[12][1:2], "2026-01-01T00:00:59Z", *rows[12][3:]), *rows[10:], *rows[28:]]
    more, late = audit.extend(stored, spark.createDataFrame(twice, shape))
    capsys.readouterr()
    more.explain()
    assert capsys.readouterr().out.count("Exchange ") == 1
    assert {r.record_id: (r.prev_hash, r.record_hash) for r in [*first, *more.collect()]} == whole and not late.count()
