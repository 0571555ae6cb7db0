"""Each operator against a brute-force version, on the small test tables and on rows made to be awkward."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldtally.llm import chat, decontam, html_text, langid, mixing, near_dup, pitman_yor, quality, secret_scan, sharding
from fieldtally.llm.queries import QUERIES
from fieldtally.llm.tables import table

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile("[0-9a-z\u0080-\U0010ffff]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, _k string, kept int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank, very long and equal texts, repeated rows, and columns with names that operators use."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(20_000))
    texts = [None, "", " \t\n", "word", LINE, LINE.upper(), long, long + " end", "é ü 日本語 " * 30, "same " * 400, "x" * 200_000]
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "a", "b"][i % 3], "clash", "clash", 7) for i, t in enumerate(texts)]
    rows += [rows[4], (None, LINE, "en", "a", None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}


def words(text):
    return WORD.findall(text or "")


# ------------------------------------------------------------------------------------------------ op1


def base_counts(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeat)


def test_quality_counts(spark, awkward, empty):
    texts = texts_of(spark)
    for r in QUERIES["op1_quality_rules"](spark, SF).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_counts(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    found = quality.repetition_report(awkward).collect()
    assert sorted(map(str, ((r["doc_id"], *[r[c] for c in quality.COUNTS]) for r in found))) == sorted(
        map(str, ((r["doc_id"], *base_counts(r["text"])) for r in awkward.collect()))
    )
    assert quality.repetition_report(empty).count() == 0 and quality.drop_repetitive(empty).count() == 0
    kept = quality.drop_repetitive(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if r["kept"]}


def test_quality_coverage(spark):
    block = " ".join(f"a{i}" for i in range(60))
    tail = " ".join(f"b{i}" for i in range(150))
    docs = spark.createDataFrame([(1, f"{block} {tail} {block}"), (2, f"{block} {tail}"), (3, f"{block}\n{block}\n{block}\n{tail}")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in quality.repetition_report(docs).collect()}
    chars = lambda t: sum(map(len, t.split()))
    assert got[1]["dup_10gram_share"] == pytest.approx(2 * chars(block) / (2 * chars(block) + chars(tail)))
    assert got[2]["dup_5gram_share"] == 0 and got[2]["kept"]
    assert got[3]["dup_line_char_share"] == pytest.approx(2 * chars(block) / (3 * chars(block) + chars(tail))) and not got[3]["kept"]


def test_quality_rejects_what_the_base_rule_passes(spark):
    """A block of b words that comes twice in a text of 200: 2 b / 200 of the words, all equally long."""
    text = lambda b: " ".join([f"a{i:03}" for i in range(b)] + [f"b{i:03}" for i in range(200 - 2 * b)] + [f"a{i:03}" for i in range(b)])
    docs = spark.createDataFrame([(b, text(b)) for b in (0, 10, 20, 24, 26, 32, 40, 48)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in quality.repetition_report(docs).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {b for b, r in got.items() if r["kept"]} == {0, 10, 20, 24}
    assert {r["doc_id"] for r in quality.drop_repetitive(docs).collect()} == {0, 10, 20, 24}


# ------------------------------------------------------------------------------------------------ op2


def check_mix(rows, sizes):
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(i), len(words(t))) for i, t, _ in sizes)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)


def test_mix(spark, awkward, empty):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, SF, "documents").collect()]
    rows = QUERIES["op2_source_mix"](spark, SF).collect()
    check_mix(rows, docs)
    source = {i: s for i, _, s in docs}
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = (r["target"], r["source_size"])
    assert all(taken[s] == round(t) for s, (t, _) in target.items())
    assert all(t <= 3 * n + 1e-6 for t, n in target.values())
    assert sum(t for t, _ in target.values()) == pytest.approx(sum(n for _, n in target.values()))
    free = {round(t / (k % 3 + 1), 6) for k, (s, (t, n)) in enumerate(sorted(target.items())) if t < 3 * n - 1e-6}
    assert len(free) == 1
    assert sorted(rows) == sorted(QUERIES["op2_source_mix"](spark, SF).collect())
    check_mix(mixing.mix_report(awkward).collect(), [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()])
    assert mixing.mix_report(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(awkward).columns == awkward.columns


def test_mix_schedule_is_even(spark):
    sizes = spark.createDataFrame([(s, 1000 * n) for s, n in (("a", 9), ("b", 40), ("c", 20), (None, 31))], "source string, size bigint")
    plan = mixing.schedule(mixing.source_targets(sizes), block_words=100).orderBy("slot").collect()
    total, slots = Counter(r["source"] for r in plan), len(plan)
    assert [r["slot"] for r in plan] == list(range(slots))
    for s in total:
        ranks = [r["rank"] for r in plan if r["source"] == s]
        assert ranks == list(range(len(ranks)))
        seen = 0
        for k, r in enumerate(plan, 1):
            seen += r["source"] == s
            assert abs(seen - k * total[s] / slots) < 4  # low discrepancy in every prefix


# ------------------------------------------------------------------------------------------------ op3


def chat_truth(turns):
    plain = [(r or "", t or "") for r, t in turns]
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in plain).encode()).hexdigest()
    loss = "".join(t for r, t in plain if r == "assistant")
    return len(plain), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    by_conv = defaultdict(list)
    for r in sorted(table(spark, SF, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        by_conv[r["conv_id"]].append((r["role"], r["text"]))
    by_conv[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    got = {r["conv_id"]: r for r in QUERIES["op3_chat_format"](spark, SF).collect()}
    assert got.keys() == by_conv.keys()
    for conv, turns in by_conv.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == chat_truth(turns)
        assert r["formatted_chars"] == sum(len(chat.formatted_turn(*t)) for t in turns)


def test_chat_awkward(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", "###" * 5 + "\\"), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, 0, "a: b### </turn>\n", " </turn>\n### user: x"), (None, 5, "assistant", "y" * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_report(frame).collect()}
    for conv in (1, 2, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == chat_truth([t[1:] for t in turns])
    assert chat.conversation_report(frame.where("false")).count() == 0


def test_chat_layouts(spark):
    records = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"instruction": "q", "output": "a"}',
        '{"prompt": "q", "completion": "a", "meta": {"score": 1}}',
        '{"question": "q", "answer": "a"}',
        '{"other": 1}', "[1]", "no json", None, "{}",
    ]
    frame = spark.createDataFrame(list(enumerate(records)), "n int, record string")
    got = defaultdict(list)
    for r in chat.canonical_turns(frame, ["n"]).orderBy("n", "part").collect():
        got[r["n"]].append((r["role"], r["text"]))
    assert all(got[i] == [("user", "q"), ("assistant", "a")] for i in range(5))
    assert all(got[i] == [(None, None)] for i in range(5, 10))
    marks = [r["fingerprint"] for r in chat.canonical_turns(frame, ["n"]).orderBy("n").collect()]
    assert len({m for m in marks if m}) == 6  # five layouts and the empty set of known paths


# ------------------------------------------------------------------------------------------------ op4


def test_shards(spark, awkward, empty):
    texts = texts_of(spark)
    rows = QUERIES["op4_hash_tree_shards"](spark, SF).collect()
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    out = sharding.sharded(awkward)
    assert out.count() == awkward.count() and set(awkward.columns) < set(out.columns)
    assert sharding.shard_report(awkward).count() == awkward.count() and sharding.sharded(empty).count() == 0


def test_shard_weights_and_movement(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    leaf = sharding.Leaf
    before = (leaf("a", "a0", 0), leaf("a", "a1", 1), leaf("b", "b0", 2), leaf("b", "b0", 3, 3.0))
    after = tuple(leaf(x.region, x.rack, x.shard, 6.0 if x.shard == 3 else x.weight) for x in before)
    both = sharding.with_shard(sharding.with_shard(keys, "doc_id", before, "x"), "doc_id", after, "y")
    counts = {r["x"]: r["count"] for r in both.groupBy("x").count().collect()}
    for x in before:
        assert counts[x.shard] == pytest.approx(20_000 * x.weight / 6, rel=0.1)
    moved = both.where("x <> y").groupBy("x", "y").count().collect()
    assert moved and all(r["y"] in (2, 3) for r in moved)  # only into region b, whose weight rose
    for tree in (before, sharding.TREE, sharding.grown(sharding.TREE)):
        n = len(tree)
        grown = sharding.with_shard(sharding.with_shard(keys, "doc_id", tree, "x"), "doc_id", sharding.grown(tree), "y")
        assert grown.where(f"x <> y AND y <> {n}").count() == 0


def test_slots_in_many_buckets(spark):
    placed = sharding.with_shard(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), "doc_id")
    slots = defaultdict(list)
    for r in sharding.with_slots(placed, "doc_id", rows_a_bucket=100).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# ------------------------------------------------------------------------------------------------ op5


def test_language(spark, awkward, empty):
    lang = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op5_word_backoff"](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    got = langid.language_report(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (0, 1, 2))
    assert langid.language_report(empty).count() == 0


def test_language_backs_off(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("singing walking talking", "en"), ("gehen stehen sehen", "de")] * 8)]
    model = langid.fit(spark.createDataFrame(rows, "id int, text string, lang string"))
    assert model.languages == ["de", "en"]
    assert model.score("running").argmax() == 1 and model.score("drehen").argmax() == 0
    assert model.unseen("日本").tolist() == [0.0, 0.0]


# ------------------------------------------------------------------------------------------------ op6

PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><div class='site-note'><p>Every page says this.</p></div>"
    "<article><h1>Head %d</h1><p>First &amp; last &lt;%d&gt; <b>bold<br>next</p><ul><li>x%d<li>y</ul><p>Read   our\nrules.</p></article>"
    "<div class=comments><p>me too</p></div><form>f</form><footer>&copy; us</footer><script>var t='</p>';</script>"
)


def test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    for r in QUERIES["op6_site_templates"](spark, SF).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_templates(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % (i, i, i)) for i in range(12)] + [(90 + i, "http://h.example/copy", PAGE % (1, 1, 1)) for i in range(30)]
    rows += [(50, "http://other.example/", PAGE % (5, 5, 5)), (51, None, None), (52, "http://[bad", "<p>open <i>never closed"), (53, "x", "</div><<p>a<p>b<!-- c")]
    rows += [(54, "http://deep.example/", "<div>" * 5000 + "in" + "</div>" * 5000)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.page_texts(pages).collect()}
    assert got[3] == "Head 3\n\nFirst & last <3> bold next\n\nx3"  # "y" and "Read our rules." recur on the host's pages
    assert got[90] == "Head 1\n\nFirst & last <1> bold next\n\nx1"  # copies of one page are no template
    assert got[50] == "Head 5\n\nFirst & last <5> bold next\n\nx5\n\ny\n\nRead our rules."
    assert (got[51], got[52], got[53], got[54]) == ("", "open never closed", "<\n\na\n\nb", "in")
    assert html_text.page_texts(pages.where("false")).count() == 0


def test_paragraphs_of_articles_stay(spark):
    page = "<html><body><article><h1>T%d</h1><p>%s</p><p>%s</p></article></body></html>"
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(12))
    rows = [(i, "http://small.example/", page % (i, own(i), "Said by five." if i < 5 else f"last {i}")) for i in range(24)]
    # near copies of an article beside other ones: they share what they share
    rows += [(100 + i, "http://near.example/", page % (i, own(0), "Shared by copies.")) for i in range(30)]
    rows += [(200 + i, "http://near.example/", page % (i, own(i), f"last {i}")) for i in range(1, 6)]
    got = {r["page_id"]: r["text"] for r in html_text.page_texts(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(got[i].endswith("Said by five.") for i in range(5)) and all(got[i].endswith(f"last {i}") for i in range(5, 24))
    assert all(got[100 + i] == f"T{i}\n\n{own(0)}\n\nShared by copies." for i in range(30))


def test_pages_at_a_larger_scale(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, LARGER, "pages").collect()}
    for r in QUERIES["op6_site_templates"](spark, LARGER).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# ------------------------------------------------------------------------------------------------ op7

ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def spans_text(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_secrets(spark, awkward, empty):
    texts = texts_of(spark)
    for r in QUERIES["op7_blob_ledger"](spark, SF).collect():
        base = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(spans_text(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for k, _, _ in base) for x in secret_scan.BASE)
    assert secret_scan.secret_report(awkward).count() == awkward.count() and secret_scan.secret_report(empty).count() == 0


def test_secret_rules_and_ledger(spark, tmp_path):
    rows = [
        "ünï token=token:abcdef Password = 'hunter22' Key", "AKIA" + "A" * 15, "AKIA" + "AKIA" * 5, "f" * 23 + " " + "0a" * 12,
        "-----BEGIN RSA PRIVATE KEY-----", "secret: ghp_" + "a" * 36, "apiKey=abcdefgh", None,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, *rows])], "doc_id int, text string")
    ledger = str(tmp_path / "ledger")
    got = {r["doc_id"]: r for r in secret_scan.secret_report(docs, ledger).collect()}
    for i, text in enumerate([*rows, *rows]):
        kept = [s for s in got[i]["spans"].split(",") if s.split(":")[0] in secret_scan.BASE]
        assert ",".join(kept) == spans_text(base_spans(text))
    assert "private_key:0:31" in got[4]["spans"] and "hosting_token" in got[13]["spans"]
    stored = spark.read.parquet(ledger)
    assert stored.count() == len(rows)  # one row a blob, although each has two paths
    secret_scan.secret_report(docs, ledger).collect()
    assert spark.read.parquet(ledger).count() == len(rows)  # nothing unseen, nothing scanned
    newer = tuple(secret_scan.Rule(r.kind, r.pattern, r.hints, r.group, r.least, 2) if r.kind == "hex" else r for r in secret_scan.RULES)
    secret_scan.scan(docs, ledger, rules=newer).collect()
    assert spark.read.parquet(ledger).where("size(rules) = 1 AND rules[0] = 'hex@2'").count() == len(rows)


# ------------------------------------------------------------------------------------------------ op8


def contamination(text, items):
    w = PLAIN.findall((text or "").translate(LOW))
    hit, ids = set(), set()
    for i, t in items:
        x = PLAIN.findall((t or "").translate(LOW))
        n = min(13, len(x))
        windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def compare_contamination(docs, items, **cols):
    got = sorted(map(str, ((r[0], *r[1:]) for r in decontam.contamination_report(docs, items).collect())))
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    assert got == sorted(map(str, ((r["doc_id"], *contamination(r["text"], pairs)) for r in docs.collect())))


def test_decontamination(spark, awkward, empty):
    docs = table(spark, SF, "documents")
    compare_contamination(docs, table(spark, SF, "benchmark"))
    filler = " ".join(f"f{i}" for i in range(100))
    item = " ".join(f"i{k}" for k in range(40))
    rows = [(i, f"{filler} " + " ".join(item.split()[i : i + 10 + i]) + f" {filler}") for i in range(20)]
    rows += [(40, "É é Tiny"), (41, "é é tiny tiny"), (42, "same " * 300), (43, item.upper()), (44, None), (45, filler + " Solo")]
    items = spark.createDataFrame([(1, item), (2, "é tiny"), (3, "same " * 30), (4, "solo"), (5, None), (6, ""), (1, item), (7, LINE), (7, LINE + " " + item)], "item_id int, text string")
    compare_contamination(spark.createDataFrame(rows, "doc_id int, text string"), items)
    compare_contamination(awkward.select("doc_id", "text"), items)
    assert decontam.contamination_report(empty, items).count() == 0
    compare_contamination(awkward.select("doc_id", "text"), items.where("false"))
    clean = decontam.decontaminated(awkward, items)
    assert clean.columns == awkward.columns
    bad = sum(contamination(r["text"], [(r2["item_id"], r2["text"]) for r2 in items.collect()])[-1] for r in awkward.collect())
    assert bad and clean.count() == awkward.count() - bad


def test_decontamination_plan_is_native(spark):
    plan = decontam.contamination_report(table(spark, SF, "documents"), table(spark, SF, "benchmark"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------------------------------------------------ op9


def test_language_model(spark, awkward, empty):
    texts = {i: words((t or "").translate(LOW)) + ["\n"] for i, t in texts_of(spark).items()}
    count = Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total, kinds = sum(count.values()), len(count)
    rows = QUERIES["op9_pitman_yor"](spark, SF).collect()
    for r in rows:
        ws = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws))
        assert r["score"] < 0
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the same outcomes: better perplexity
    got = pitman_yor.score_report(awkward).collect()
    assert len(got) == awkward.count() and all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (0, 1, 2))
    assert pitman_yor.score_report(empty).count() == 0
    few = pitman_yor.score_report(table(spark, SF, "documents"), settings=pitman_yor.Settings(hot_words=10))
    assert {r["doc_id"]: round(r["base_score"], 6) for r in few.collect()} == {r["doc_id"]: round(r["base_score"], 6) for r in rows}


def test_word_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i % k}" for i in range(900)), True) for k in (3, 17, 400)] + [("never seen", False)], "text string, train boolean")
    types = pitman_yor.word_counts(docs)
    tokens = types.agg({"n": "sum"}).first()[0]
    got = pitman_yor.word_scores(types, tokens, pitman_yor.SETTINGS).collect()
    unknown = {r["score"] for r in got if r["n"] == 0}
    assert len(unknown) == 1 and sum(r["n"] == 0 for r in got) == 2
    assert sum(10 ** r["score"] for r in got if r["n"] > 0) + 10 ** unknown.pop() == pytest.approx(1.0)
    none = pitman_yor.score_report(spark.createDataFrame([(i, "all held out") for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id bigint, text string"))
    assert all((r["base_score"], r["train_tokens"]) == (0.0, 0) and -0.02 < r["score"] <= 0 for r in none.collect())


def test_training_word_order_counts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    run = [f"w{k}" for k in range(40)]

    def score(order):
        docs = spark.createDataFrame([(held, " ".join(run))] + [(i, " ".join(order)) for i in train], "doc_id int, text string")
        found = {r["doc_id"]: r for r in pitman_yor.score_report(docs).collect()}
        few = {r["doc_id"]: r for r in pitman_yor.score_report(docs, settings=pitman_yor.Settings(hot_words=0, hot_pairs=0)).collect()}
        assert all(found[i]["score"] == pytest.approx(few[i]["score"]) and found[i]["n_known"] == few[i]["n_known"] for i in found)
        return found[held]["score"], found[held]["base_score"]

    same, turned = score(run), score(run[::-1])
    assert same[1] == pytest.approx(turned[1]) and same[0] > turned[0] + 40  # a factor of ten a word at least


def test_pair_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i * i % k}" for i in range(300)), True) for k in (3, 17, 101)] + [("never seen", False)], "text string, train boolean")
    scores, pairs = pitman_yor.pair_scores(pitman_yor.word_counts(docs), pitman_yor.pair_counts(docs.where("train").select("text")), pitman_yor.SETTINGS)
    singles = {r["h"]: r for r in scores.collect()}
    after = defaultdict(dict)
    for r in pairs.collect():
        after[r["u"]][r["w"]] = r["p"]
    unknown = next(r["p"] for r in singles.values() if r["n"] == 0)
    for u, seen in after.items():
        rest = sum(r["p"] for h, r in singles.items() if r["n"] > 0 and h not in seen) + unknown
        assert sum(seen.values()) + singles[u]["back"] * rest == pytest.approx(1.0)


def test_spelling_is_a_distribution():
    import numpy as np

    cells, _ = pitman_yor.spelled_cells(__import__("pyarrow").array([b"ab", b"abc", b"", b"ba"]))
    keys, n = np.unique(cells, return_counts=True)
    spelling = pitman_yor.seated_spelling(keys, n * 5, pitman_yor.UNIFORM, pitman_yor.SETTINGS, 1)
    for context in (256 * 257 + 256, 256 * 257 + 97, 97 * 257 + 98, 5 * 257 + 6):
        assert (10 ** spelling.log10(context * 257 + np.arange(257))).sum() == pytest.approx(1.0)


def test_tables_have_the_right_mean():
    import numpy as np

    n, pull, d = 40, 3.0, 0.5
    expected, chances = 0.0, {1: 1.0}
    for i in range(1, n):
        after = defaultdict(float)
        for t, p in chances.items():
            new = pull / (pull + i - d * t)
            after[t + 1] += p * new
            after[t] += p * (1 - new)
        chances = after
    expected = sum(t * p for t, p in chances.items())
    drawn = pitman_yor.tables_of(np.full(20_000, n), np.full(20_000, pull), d, np.random.default_rng(0))
    assert drawn.mean() == pytest.approx(expected, rel=0.01) and drawn.min() >= 1 and drawn.max() <= n


# ------------------------------------------------------------------------------------------------ op10


def shingles(text):
    w = PLAIN.findall((text or "").translate(LOW))
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def probability_jaccard(x, y):
    every, sums = set(x) | set(y), {}
    for weights in {(x[i], y[i]) for i in set(x) & set(y)}:
        sums[weights] = sum(max(x[j] / weights[0], y[j] / weights[1]) for j in every)
    return sum(1 / sums[x[i], y[i]] for i in set(x) & set(y))


def brute_classes(rows):
    bags = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            x, y = bags[i], bags[j]
            if x == y or len(set(x) & set(y)) > 0.5 * max(len(x), len(y)) and probability_jaccard(x, y) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    classes = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            classes[root(i)].append(k)
    return [(k, min(classes[root(i)], default=None)) for i, (k, _) in enumerate(rows)]


def test_near_duplicates(spark, awkward, empty):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((r["doc_id"], r["class_id"]) for r in near_dup.near_duplicates(docs).collect())
    assert got == sorted(brute_classes(rows))
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = [(r["doc_id"], r["class_id"]) for r in near_dup.near_duplicates(awkward).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_classes(rows)))
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.one_of_each(empty).count() == 0
    kept = near_dup.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()]
    assert sorted(ids) == sorted({c for i, c in brute_classes(rows) if i is not None and i == c})


def test_near_duplicates_in_crowded_buckets(spark, monkeypatch):
    """A chain of edits: ends are unlike, neighbours alike; small limits send it through centres and blocks."""
    monkeypatch.setattr(near_dup, "FEW", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "PROBES", 5)
    text, rows = [f"t{i}" for i in range(80)], []
    for k in range(40):
        rows.append((k, " ".join(text)))
        text[(k * 7) % 80] = f"e{k}"
    rows += [(100 + k, " ".join(f"t{i}" if i < 30 else f"z{k}y{i}" for i in range(80))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted((r["doc_id"], r["class_id"]) for r in near_dup.near_duplicates(docs).collect())
    assert got == sorted(brute_classes(rows))


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    x = {int(i): int(w) for i, w in zip(rng.integers(1 << 40, size=120), rng.integers(1, 6, 120), strict=True)}
    y = dict(list(x.items())[:90]) | {int(i): 1 for i in rng.integers(1 << 40, size=25)}
    row = np.repeat([0, 1], [len(x), len(y)])
    ids, weights = np.array([*x, *y], dtype=np.uint64), np.array([*x.values(), *y.values()])
    signature = near_dup.prob_min_hash(2, row, ids, weights, 4096)
    truth = probability_jaccard(Counter(x), Counter(y))
    assert (signature[0] == signature[1]).mean() == pytest.approx(truth, abs=0.03)
    exact = near_dup.probability_jaccard(ids[: len(x)], weights[: len(x)], ids[len(x) :], weights[len(x) :])
    assert exact == pytest.approx(truth)
