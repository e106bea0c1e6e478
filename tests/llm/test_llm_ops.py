"""Operators of the llm subpackage against plain models and on odd input."""

from __future__ import annotations

import glob
import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logfathom.llm import bpe, frequencies, leaks, pii, queries, runs, spans
from tests.test_oracles import bag


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, data, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.SQL:
        assert bag(got) == bag(duck.execute(queries.SQL[name]).fetchdf())
    else:
        assert len(got)


# frequencies

def count(spark, rows, **kw):
    df = spark.createDataFrame(rows, "f string, t string, r string, n bigint").withColumn("n_total", F.lit("clash")).withColumn("route", F.lit(0))
    out = frequencies.term_frequencies(df, F.col("f"), F.col("t"), F.col("r"), F.col("n"), **kw)
    return {(x["field"], x["term"]): (x["n_total"], x["n_records"]) for x in out.collect()}


@pytest.mark.parametrize("kw", [{}, {"burst": 2, "route_terms": 3}])
def test_frequencies_like_counter(spark, kw):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.choice(["", "x", "xy", "xyz", "xyq", "é", "long" * 1000, None] + [f"x{k}" for k in range(40)]), r.choice(["1", "2", "3", None]), r.choice([0, 1, 5, None])) for _ in range(2000)]
    total, records = Counter(), defaultdict(set)
    for f, t, rec, n in rows:
        if t is not None and n:
            total[(f, t)] += n
            if rec is not None:
                records[(f, t)].add(rec)
    assert count(spark, rows, **kw) == {k: (n, len(records[k])) for k, n in total.items()}


def test_frequencies_of_nothing(spark):
    assert count(spark, []) == {}
    assert count(spark, [("a", None, "1", 1), ("a", "x", "1", 0)]) == {}


@given(st.lists(st.tuples(st.text("ab", max_size=5), st.integers(1, 3)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_trie_holds_every_term(pairs):
    trie, want = frequencies.BurstTrie(burst=2), Counter()
    for term, n in pairs:
        trie.add(term, n, 1)
        want[term] += n
    got = {prefix + suffix: trie.totals[k] for prefix, node in trie.leaves() for suffix, k in node.items()}
    assert got == dict(want)


# runs

def run_model(rows, gap=None):
    by = defaultdict(dict)
    for entity, key, event, us, line in rows:
        if entity is not None and us is not None:
            by[entity][(us, -1 if line is None else line, event)] = key
    out = Counter()
    for entity, events in by.items():
        cur = None
        for (us, _, event), key in sorted(events.items()):
            if cur and cur[0] == key and (gap is None or us - cur[4] <= gap):
                cur[2], cur[3], cur[4] = event, cur[3] + 1, us
            else:
                if cur and cur[3] > 1:
                    out[(entity, cur[1], cur[2], cur[3])] += 1
                cur = [key, event, event, 1, us]
        if cur and cur[3] > 1:
            out[(entity, cur[1], cur[2], cur[3])] += 1
    return out


def collapse(spark, rows, **kw):
    df = spark.createDataFrame(rows, "e string, k string, id string, us bigint, line bigint").withColumn("n_events", F.lit("clash")).withColumn("entity", F.lit(1))
    out = runs.collapse_runs(df, F.col("e"), [F.col("k")], F.col("id"), F.col("us"), F.col("line"), **kw)
    return Counter((r["entity"], r["first_event_id"], r["last_event_id"], r["n_events"]) for r in out.collect())


@pytest.mark.parametrize("seed", range(3))
def test_runs_like_model(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "cold", None]), r.choice(["x", "x", "y", None]), f"e{k:04}", r.choice([None, *range(90)]), k) for k in range(600)]
    rows += r.sample(rows, 50)
    assert collapse(spark, rows) == run_model(rows)
    assert collapse(spark, rows, max_gap_us=1) == run_model(rows, 1)


def test_one_run_over_all_partitions(spark):
    rows = [("f", "x", f"e{k:05}", k, k) for k in range(5000)]
    assert collapse(spark, rows) == Counter({("f", "e00000", "e04999", 5000): 1})


@pytest.mark.parametrize("parts", [3, 8])
def test_one_run_with_tied_times_at_the_cuts(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for step in (400, 130, 1000):
            rows = [("f", "x", f"e{(k * 7919) % 1000:04}", k // step, k) for k in range(1000)]
            assert collapse(spark, rows) == run_model(rows) == Counter({("f", "e0000", f"e{(999 * 7919) % 1000:04}", 1000): 1})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_near_identical_events_keep_their_anchor(spark):
    df = spark.createDataFrame([("f", "x", 1, "a", 1), ("f", "x", 2, "b", 2), ("f", "y", 2, "c", 3)], "e string, k string, p int, id string, us bigint")
    out = runs.collapse_runs(df, F.col("e"), [F.col("k"), F.col("p")], F.col("id"), F.col("us"), F.lit(0), min_similarity=0.5)
    assert [(r["first_event_id"], r["last_event_id"], r["n_events"]) for r in out.collect()] == [("a", "b", 2)]


def test_runs_of_nothing(spark):
    assert not collapse(spark, [])
    assert not collapse(spark, [("f", "x", "a", None, 1), (None, "x", "b", 1, 1)])


# tokens

TOKENIZER = bpe.vocabulary_path("byte_bpe_50k.json")
need_files = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabularies")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary(bpe.vocabulary_path()))


@need_files
@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_like_the_public_tokenizer(reference, encoder, text):
    assert encoder.encode(text) == reference.encode(text, add_special_tokens=False).ids


@need_files
@given(st.text("abcdehilnorst", min_size=1, max_size=200))
@settings(max_examples=200, deadline=None)
def test_long_words_like_the_public_tokenizer(reference, encoder, text):
    assert encoder.encode(text) == reference.encode(text, add_special_tokens=False).ids


@need_files
def test_ids_of_odd_texts(spark, reference):
    texts = ["", None, " ", "<|endoftext|>", "a" * 50_000, "\x00​", "日本語" * 2000, " \n\n \t", "it's we'll 123456789"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "x", ""), (0, "", "")], "doc_id bigint, text string, ids string")
    rows = bpe.token_ids(df, F.col("doc_id"), F.col("text")).collect()
    got = {r["doc_id"]: r["ids"] for r in rows}
    assert len(rows) == len(texts) + 2
    assert all(got[k] == reference.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts))
    assert bpe.token_ids(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0


# leaks

def find_leaks(spark, docs, items, span=12, gram=8, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item", F.lit("clash")).withColumn("print", F.lit(0))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(5))
    return Counter((r["doc_id"], r["item_id"]) for r in leaks.leaked_items(d, F.col("doc_id"), F.col("text"), i, F.col("item_id"), F.col("text"), span, gram, **kw).collect())


def leak_model(docs, items, span):
    grams = lambda t: {tuple(w[k : k + span]) for w in [leaks.words(t)] for k in range(len(w) - span + 1)}
    return Counter({(d, i): 1 for d, t in docs for i, u in items if None not in (d, t, i, u) and grams(t) & grams(u)})


@pytest.mark.parametrize("seed", range(3))
def test_leaks_like_model(spark, seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["a", "b", "ß", "7"]) for _ in range(n))
    docs = [(k, text(r.randrange(40))) for k in range(60)] + [(3, None), (None, text(30)), (7, ""), (8, text(20))]
    items = [(k, text(r.randrange(3, 14))) for k in range(20)] + [(30, None), (31, "")]
    assert find_leaks(spark, docs, items, 5, 3) == leak_model(docs, items, 5)
    assert find_leaks(spark, docs, items, 5, 3, most_items=0) == leak_model(docs, items, 5)


def test_leak_in_another_dress(spark):
    item = "Which step comes first when tie breaker L669 reports that its replication stream has fallen behind"
    dressed = "x " + item.upper().replace(" ", " -- ").replace("THAT", "«that»") + " y" + " z" * 20_000
    short = " ".join(item.split()[:11])
    assert find_leaks(spark, [(1, dressed), (2, short), (3, item.replace("tie", "a"))], [(9, item), (10, item)]) == Counter({(1, 9): 1, (1, 10): 1, (3, 9): 0, (3, 10): 0}) - Counter()


def test_leaks_of_nothing(spark):
    assert not find_leaks(spark, [], [(1, "a " * 20)])
    assert not find_leaks(spark, [(1, "a " * 20)], [])


# spans

def span_model(docs, span):
    seen = defaultdict(set)
    for d, t in docs:
        for k in range(len(t or "") - span + 1):
            if d is not None:
                seen[t[k : k + span]].add(d)
    out = {}
    for d, t in docs:
        if d is None or not t:
            continue
        hit = set()
        for k in range(len(t) - span + 1):
            if len(seen[t[k : k + span]]) > 1:
                hit.update(range(k, k + span))
        if hit:
            out[d] = len(hit)
    return out


def find_spans(spark, docs, span, **kw):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("shared_chars", F.lit("clash")).withColumn("pos", F.lit("x"))
    return {r["doc_id"]: r["shared_chars"] for r in spans.shared_spans(df, F.col("doc_id"), F.col("text"), span, **kw).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_spans_like_model(spark, seed):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdé😀") for _ in range(r.randrange(15, 60))) for _ in range(6)]
    docs = []
    for k in range(60):
        parts = []
        for _ in range(r.randrange(5)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            parts.append(p[a : a + r.randrange(1, 60)] if r.random() < 0.7 else "".join(r.choice("abcd") for _ in range(r.randrange(30))))
        docs.append((k, "".join(parts)))
    docs += [(100, None), (101, ""), (102, "aaaa" * 40), (103, "aaaa" * 30), (104, "bcbc" * 30 + passages[0])]
    assert find_spans(spark, docs, 20) == span_model(docs, 20)
    assert find_spans(spark, docs, 20, bits=4) == span_model(docs, 20)  # a sketch that is full loses nothing


def test_repeated_rows_and_repeats_within_share_nothing(spark):
    a, b = "x1y2z3" * 100, "".join(chr(97 + k % 26) + str(k) for k in range(300))
    assert find_spans(spark, [(1, b), (1, b), (2, a)], 300) == {}
    assert find_spans(spark, [(1, b[:300]), (2, "-" + b[:300]), (3, b[:299])], 300) == {1: 300, 2: 300}
    assert find_spans(spark, [], 300) == {}


# personal data

def found(text):
    return [(kind, text[a:z]) for a, z, kind in pii.spans(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("owner=ann.lee+x@corp.example; z", [("email", "ann.lee+x@corp.example")]),
        ("mailto:ann [at] corp [dot] example bounced", [("email", "ann [at] corp [dot] example")]),
        ("write to ann at corp dot example dot org now", [("email", "ann at corp dot example dot org")]),
        ("mail аnn@corp.example", [("email", "аnn@corp.example")]),
        ("mail ann​@corp.example", [("email", "ann​@corp.example")]),
        ("mail ann＠corp．example", [("email", "ann＠corp．example")]),
        ("unit getty@tty1.service restarted; ops@node-45; app@sha256:ab12", []),
        ("call me on +55 (11) 95550-3736 before", [("phone", "+55 (11) 95550-3736")]),
        ("tel:+46 8 555 77 71", [("phone", "+46 8 555 77 71")]),
        ("phone five five five oh one two three", [("phone", "five five five oh one two three")]),
        ("sms to 555-0194 failed, link 1000-7558-3569 up, serial 8645-2541-83B", [("phone", "555-0194")]),
        ("tax id QQ 48 90 09 A found", [("id_number", "QQ 48 90 09 A")]),
        ("Ausweis-Nr. 62303850G (Marit de la Marne)", [("id_number", "62303850G"), ("name", "Marit de la Marne")]),
        ("pid 30202 raft index 995151349 term 27 id ab", []),
        ("site contact O'Dunmore, Hideo, Flat 4, 21 Old Ferry Street, Puente Alba 12345; x", [("name", "O'Dunmore, Hideo"), ("address", "Flat 4, 21 Old Ferry Street, Puente Alba 12345")]),
        ("moved to Lindenstraße 226a, 51334 Puente Alba\"", [("address", "Lindenstraße 226a, 51334 Puente Alba")]),
        ("at 60 boulevard des Forges, 44597 Emberton Leader Election by Raft Core", [("address", "60 boulevard des Forges, 44597 Emberton")]),
        ("handed over from ÅSA VON HOLLSTEDT to B. Lee; Mr. Zoë K. Lee asked", [("name", "ÅSA VON HOLLSTEDT"), ("name", "B. Lee"), ("name", "Zoë K. Lee")]),
        ("Docker Engine on Node Manager restarted; Leader Election by Raft Core", []),
        ("contact [EMAIL] or [PHONE] (72 Street-cache misses) Lane 7 down", []),
        ("", []),
    ],
)
def test_personal_data(text, want):
    assert found(text) == want


def test_masking_keeps_the_rest():
    text = "a ann@corp.example, +15550102094 b"
    assert pii.masked(text, pii.spans(text)) == "a [EMAIL], [PHONE] b"


def test_cut_texts():
    whole = "acknowledged by Marit Drumgelloch <ann@corp.example> today"
    at = whole.index("Drum") + 4
    assert pii.whole_spans(whole[:at] + "…", whole) == []
    assert pii.whole_spans(whole[:at] + "…") == []
    end = whole.index(" <")
    assert [whole[a:z] for a, z, _ in pii.whole_spans(whole[:end] + "…", whole)] == ["Marit Drumgelloch"]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_spans_lie_in_the_text(text):
    for t in (text, text + " ann@corp.example"):
        last = 0
        for a, z, _ in pii.spans(t):
            assert last <= a < z <= len(t)
            last = z


def test_personal_data_of_odd_rows(spark):
    rows = [("1", "mail ann@corp.example", None), ("2", None, "mail ann@corp.ex…"), ("3", "", ""), ("4", "x" * 200_000 + " ann@corp.example", "n"), ("1", "mail ann@corp.example", None), (None, "tel:+15550102094", "tel:+15550102094")]
    df = spark.createDataFrame(rows, "k string, message string, excerpt string").withColumn("found", F.lit(1)).withColumn("masked_message", F.lit(1))
    got = pii.personal_data(df, [F.col("k")], ["message", "excerpt"])
    all_ = [(r["k"], [(f["field_name"], f["found_text"]) for f in r["found"]], r["masked_message"]) for r in got.collect()]
    assert Counter((k, tuple(f)) for k, f, _ in all_) == Counter({("1", (("message", "ann@corp.example"),)): 2, ("2", ()): 1, ("3", ()): 1, ("4", (("message", "ann@corp.example"),)): 1, (None, (("message", "+15550102094"), ("excerpt", "+15550102094"))): 1})
    assert {k: m for k, _, m in all_}["3"] == "" and {k: m for k, _, m in all_}["2"] is None
    assert pii.personal_data(df.limit(0), [F.col("k")], ["message"]).count() == 0


# personal data beyond cue words, and checks before detectors

@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("call three four six seven eight three four six", [("phone", "three four six seven eight three four six")]),
        ("tel: 089/123456", [("phone", "089/123456")]),
        ("tel 05 12345", [("phone", "05 12345")]),
        ("0171 2345678", [("phone", "0171 2345678")]),
        ("(operator Zoe Quux, callback +44 20 7946 0105)", [("name", "Zoe Quux"), ("phone", "+44 20 7946 0105")]),
        ("id#X1234567A", [("id_number", "X1234567A")]),
        ("Please ask Anna Schmidt about the outage", [("name", "Anna Schmidt")]),
        ("Thanks, John Miller", [("name", "John Miller")]),
        ("contact: Ольга Иванова", [("name", "Ольга Иванова")]),
        ("assigned to 王伟", [("name", "王伟")]),
        ("ул. Ленина 5, Москва", [("address", "ул. Ленина 5, Москва")]),
        ("contact: Prometheus Alertmanager", []),
        ("opened by: Leader Jones", [("name", "Leader Jones")]),
        ("x@y [punkt] de", [("email", "x@y [punkt] de")]),
    ],
)
def test_pieces_in_plain_sentences(text, want):
    assert [(kind, text[a:z]) for a, z, kind in pii.spans(text)] == want


DETECTORS = [
    (pii._ID, lambda t, low: any(h in low for h in pii._ID_HINTS)),
    (pii._ID_ALONE, lambda t, low: pii._LONG_NUMBER.search(t)),
    (pii._ADDRESS, lambda t, low: any(h in low for h in pii._ROAD_HINTS)),
    (pii._NAMED, lambda t, low: pii._BRACKETED.search(t) or any(h in low for h in pii._NAME_HINTS)),
    (pii._NAMED_AFTER, lambda t, low: any(h in low for h in pii._NAME_HINTS)),
]


@pytest.mark.parametrize("k", range(len(DETECTORS)))
@given(st.data())
@settings(max_examples=150, deadline=None)
def test_checks_let_through_all_that_detectors_find(k, data):
    pattern, check = DETECTORS[k]
    text = data.draw(st.from_regex(pattern))
    assert not pattern.search(text) or check(text, text.lower())


@given(st.from_regex(pii._PHONE))
@settings(max_examples=150, deadline=None)
def test_phones_pass_their_check(text):
    m = pii._PHONE.search(text)
    assert m is None or pii._digits(m["local"] or m[0]) < 7 or pii._CALLABLE.search(text)
