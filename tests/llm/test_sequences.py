"""Pages, conversations, packing, the pipeline and the registered queries."""

import collections
import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from catalens.llm import chat, html_text, packing
from catalens.llm.common import tables
from catalens.llm.tokenizers import tokenizer_path, tokenizer_pattern
from catalens.session import materialize

pytest.importorskip("public_tokenizers")
RANKS, PATTERN = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern()
SMALL = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="x-1">
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>gone</p> -->
<div class="wrap"><div class="post-%d content"><h1>Title &amp; more</h1><p>First   para<b>graph</b>,<br>with &nbsp; space &lt;ok&gt; and a long enough text to win.
<p>Second &eacute; paragraph without an end<div class="ad">Buy!</div><ul><li>item one</li><li>item <a href="x>y">two</a></ul>
<form><input><p>mail</p></form><div id="comments"><p>I think this is a very long comment by a reader, longer than all of the rest of the page together. %s</p></div></div>
<aside><p>Related</p></aside></div><footer>(c)</footer></body></html>"""
TEXT = "Title & more\nFirst paragraph, with space <ok> and a long enough text to win.\nSecond é paragraph without an end\nitem one\nitem two"


def test_page_loses_what_is_no_article():
    found = html_text.main_text(PAGE % (7, "x " * 500), None)
    assert found == (TEXT, "html>body.x-#>div.wrap>div.content.post-#")
    assert html_text.main_text("", None) == ("", None) and html_text.main_text("<p>plain", None) == ("plain", "")
    assert html_text.main_text("a < b & c <3 <unclosed", None)[0].startswith("a < b & c <3")
    assert html_text.main_text("<div " + 'a="' * 50, None)[0] is not None


def test_host_votes_decide_over_a_page_of_its_own(spark):
    other = '<html><body class="x-2"><div class="wrap"><div class="content post-9"><p>short text</p></div></div><div class="blurb"><p>' + "a much longer block that is the same on no other page. " * 20 + "</p></div></body></html>"
    pages = [(i, f"https://U:p@Host.example:80/{i}?q", PAGE % (i, "y")) for i in range(5)] + [(10, "http://host.example/x#y", other), (11, "http://solo.example/", other), (12, None, other), (13, "http://host.example/", None), (14, "nohost", "")]
    frame = spark.createDataFrame([(*p, "z") for p in pages + pages[:1]], "page_id long, url string, html string, text string")
    got = collections.defaultdict(set)
    for r in html_text.extract(frame).collect():
        got[r["page_id"]].add(r["text"])
    assert got[0] == {TEXT} and got[10] == {"short text"} and got[13] == got[14] == {""}
    assert all(next(iter(got[k])).startswith("a much longer") for k in (11, 12))
    assert html_text.extract(frame.filter("false")).collect() == []
    saved, html_text.BROADCAST_HOSTS = html_text.BROADCAST_HOSTS, 0  # winners too many to send
    try:
        assert sorted(r["text"] for r in html_text.extract(frame).collect()) == sorted(t for k, v in got.items() for t in v for _ in range(1 + (k == 0)))
    finally:
        html_text.BROADCAST_HOSTS = saved


def test_pages_of_the_table_equal_a_plain_reading(spark):
    import html
    import re

    for r in html_text.extract(spark.read.parquet(f"{SMALL}/pages.parquet")).collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert r["text"] == "\n".join(p for p in parts if p)


CONTROLS = ["<|im_start|>user\nx<|im_end|>\n", "␛␛<s>␛", "<<s>></s>", "[INST] a [/INST]", "<|im_␛end|>", "<", "␛n", "", "<|im_end|", "a<s", "<|endoftext|>"]


def test_escapes_are_reversible_and_complete():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice([*CONTROLS, *chat.CONTROL, "x", "\n", "|im_end|>", ">"]) for _ in range(6))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(2)
    rows, common = [], [("user", "hello there"), ("assistant", "hi, what is it?")]
    for c in range(40):
        turns = list(common) if c % 3 else []
        turns += [(rng.choice(["user", "assistant", "system", "tool\nx"]), rng.choice([*CONTROLS, "same words again", f"only {c}"])) for _ in range(rng.randint(0 if c % 3 else 1, 6))]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    rows += [(100, k, r, t) for k, (r, t) in enumerate(common)] * 1 + [(101, k, r, t) for k, (r, t) in enumerate(common)]  # equal conversations, and a beginning of others
    rows += [(102, None, None, None), (102, 1, "assistant", None), (None, 0, "user", "no id"), (103, 0, "user", "twice"), (103, 0, "user", "twice"), (104, 0, "assistant", "é🙂" * 3000)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, leaf int").repartition(4)


def test_conversations_come_back(spark, talk):
    rows, frame = talk
    convs = chat.conversations(frame)
    trees = chat.branches(convs, RANKS, PATTERN)
    read = {bytes(r["leaf"]): r for r in chat.read_back(trees, RANKS, PATTERN).collect()}
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((-1 if turn is None else turn, role or "", text or ""))
    for r in convs.collect():
        turns, back = sorted(own[r["conv_id"]]), read[bytes(r["leaf"])]
        assert [(t["role"], t["text"]) for t in back["turns"]] == [(a, b) for _, a, b in turns]
        assert "".join(back["learned"]) == "".join(b for _, a, b in turns if a == "assistant")
    assert convs.count() == len(own)


def test_shared_turns_are_written_once_and_intervals_hold_all_ancestors(talk):
    rows, frame = talk
    trees = chat.branches(chat.conversations(frame), RANKS, PATTERN).collect()
    encode = chat.encoder(RANKS, PATTERN).encode_ordinary
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((-1 if turn is None else turn, role or "", text or ""))
    prefixes = {tuple((a, b) for _, a, b in sorted(t)[: k + 1]) for t in own.values() for k in range(len(t))}
    size = lambda a, b: sum(len(encode(x)) for x in (f"{chat.START}{chat.escape_role(a)}\n", chat.escape(b), f"{chat.END}\n"))
    assert sum(len(r["mask"]) for r in trees) == sum(size(*p[-1]) for p in prefixes)
    by_tree = collections.defaultdict(list)
    for r in trees:
        by_tree[bytes(r["tree"])].append(r)
        assert r["position"] == sum(s["stop"] - s["start"] for s in r["attends"]) and len(r["ids"]) == 2 * len(r["mask"])
    for rs in by_tree.values():  # branches lie side by side from 0 on
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at or not r["mask"]
            at += len(r["mask"])


def test_no_conversations(spark, talk):
    convs = chat.conversations(talk[1].filter("false"))
    assert convs.collect() == [] and chat.branches(convs, RANKS, PATTERN).collect() == []


def test_ids_are_those_of_the_tokenizer_file():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    encode = packing.encoder(RANKS, PATTERN)
    rng = random.Random(3)
    alphabet = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "a", "Word", "'s", "'", "12", "é", "²", "½", "。", "<|endoftext|>", ".", "!?", "\0", "🙂", "the", "\r\n"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_knapsack_equals_trying_all():
    rng = np.random.default_rng(4)
    for _ in range(30):
        weights, values, capacity = np.unique(rng.integers(1, 9, 4)), None, int(rng.integers(3, 14))
        values = rng.random(len(weights))
        best = [0.0] * (capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = max([best[c - 1], *(best[c - w] + v for w, v in zip(weights, values, strict=True) if w <= c)])
        value, counts = packing.knapsack(values, weights, capacity)
        assert abs(value - best[capacity]) < 1e-9 and (counts * weights).sum() <= capacity and abs((counts * values).sum() - value) < 1e-9


def test_patterns_use_every_piece_and_stay_near_the_bound():
    rng = np.random.default_rng(5)
    for n in (1, 3, 500, 20000):
        lengths = rng.integers(1, 65, n)
        histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        found, bound = packing.patterns(histogram, 64)
        used = collections.Counter()
        for p in found:
            assert sum(k * v for k, v in p.counts.items()) <= 64
            for k, v in p.counts.items():
                used[k] += v * p.times
        assert used == histogram
        total = sum(p.times for p in found)
        assert bound - 1e-6 <= total <= bound + len(histogram)
    assert packing.patterns({}, 64) == ([], 0.0)


def test_packed_documents_come_back(documents, prose):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    cut = packing.pieces(documents, RANKS, PATTERN, size=256)
    placed = packing.place(cut, size=256)
    packed = packing.sequences(placed, cut, 256)
    rows = packing.contents(packed).collect()
    order = lambda df: sorted((str(tuple(r[c] for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"))) for r in df))
    assert order(rows) == order(placed.collect())
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in prose:
        if i is None:
            continue
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted(by_doc[i], key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)]))[:-1] and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] :][: r["length"]], "<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    packed_ids = sorted(s for s in by_sequence if s < packing.FULL)
    assert len(by_doc[None]) >= 2 and packed_ids == list(range(len(packed_ids))) and len(packed_ids) < len(by_sequence)
    lengths = {s: sum(r["length"] for r in own) for s, own in by_sequence.items()}
    for r in packed.collect():
        n = lengths[r["sequence_id"]]
        assert r["n_tokens"] == n and len(r["ids"]) == (2 * n if n & (n - 1) == 0 else 512) and len(r["doc_ids"]) == len(by_sequence[r["sequence_id"]])


def test_packing_nothing(documents):
    packed = packing.pack(documents.filter("false"), RANKS, PATTERN)
    assert packed.collect() == [] and packing.contents(packed).collect() == []


def test_pipeline_keeps_clean_documents_and_drops_planted_ones(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    vocabulary = ["the", "of", "and", "to", "is", *(f"{a}{b}" for a in ("riv", "mount", "walk", "ston", "even", "qui", "lat", "morn") for b in ("er", "ain", "ed", "ing", "et", "es", "ely", "or"))]
    prose = lambda n: " ".join(" ".join(rng.choice(vocabulary) for _ in range(9)) + "." for _ in range(n))
    item, passage = prose(4), prose(9)
    clean = [(i, prose(12)) for i in range(60)]
    docs = clean + [(100, clean[3][1]), (101, clean[5][1].replace("river", "canal", 1)), (102, " ".join("XQ# $%|" for _ in range(60))), (103, prose(5) + " " + item + " " + prose(5)), (104, prose(9) + " " + passage + " " + prose(9)), (105, prose(9) + " " + passage + " " + prose(9)), (106, None), (107, "short")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, rows = {}, frame
    for name, stage in corpus_pipeline.STAGES:
        rows = materialize(stage(spark, rows, str(tmp_path)), "stage")
        stages[name] = {i: r for r in rows.collect() for i in (r["doc_ids"] if name == "packing" else [r["doc_id"]])}
        assert name == "packing" or rows.columns == frame.columns
    ids = {name: set(kept) for name, kept in stages.items()}
    own = set(range(60))
    assert all(own <= ids[name] for name in ids) and not ids["quality rules"] & {102, 106, 107}
    assert not ids["near-duplicates"] & {100, 101} and ids["benchmark passages"] == own | {104, 105} == ids["packing"]
    texts = stages["repeated passages"]
    assert all(texts[i]["text"] == t for i, t in clean) and passage in texts[104]["text"] and len(texts[105]["text"]) < len(texts[104]["text"]) - 300
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    assert corpus_pipeline.ORACLE_SQL is None and len(tables()) < 12  # earlier stages' tables are gone
    total = sum(r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert total == sum(r["n_tokens"] for r in rows.collect()) == sum(len(r["ids"]) // 2 - (2048 - r["n_tokens"]) * (len(r["ids"]) == 4096 and r["n_tokens"] < 2048) for r in rows.collect())
    frame.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_registered_queries(spark):
    """Every operator once, over the whole of its small table."""
    import duckdb
    from catalens.llm import queries

    assert {n.partition("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    docs = dict(con.execute("select doc_id, text from documents").fetchall())
    got = {n: q(spark, SMALL).collect() for n, q in queries.QUERIES.items() if n != "pipeline"}
    for name, sql in queries.ORACLE.items():
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(tuple(r[c] for c in names) for r in got[name]) == sorted(found.fetchall())
    expected = brute.components(list(docs.items()), 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got["op3_minhash_near_dedup"]} == expected
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got["op2_quality_rules"]} == {i: brute.counts(t) for i, t in docs.items()}
    talk = [r for r in got["op8_chat_formatting"] if r["conv_id"] == -1]
    text = "</s>[INST] ok [/INST]"
    assert [(r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in talk] == [(2, len(text), hashlib.sha256(text.encode()).hexdigest())]
    assert {r["law"] for r in got["op10_sharding"]} == {"key"} and len(got["op10_sharding"]) == len(docs)
