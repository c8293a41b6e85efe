"""Encoding, secrets, chats and fingerprints against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonegrid.llm import byte_pairs, chat_format, digests, queries, secret_scan

ODD = "doc_id long, text string, _id long, _text string, spans string, ids string"
LONG = "wort " * 60_000 + " " * 5000 + "end\n\n"


def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, "  \n "), (4, LONG), (5, "same text, token = abcdef12"), (5, "same text, token = abcdef12"), (None, "no id \U0001f600"), (7, "x")]
    return spark.createDataFrame([(i, t, 9, "clash", "clash", "clash") for i, t in rows], ODD)


@pytest.fixture(scope="module")
def enc():
    return byte_pairs.encoding(*queries.byte_ranks())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'sé1\n\t  !\x1c\U0001f600"), max_size=120))
def test_parts_encode_like_the_whole(enc, text):
    old = byte_pairs.PART, byte_pairs.LONG_BLANK, byte_pairs._BLANKS
    byte_pairs.PART, byte_pairs.LONG_BLANK, byte_pairs._BLANKS = 8, 3, re.compile(f"[{byte_pairs.BLANK}]{{3,}}")
    try:
        assert byte_pairs.encode_text(enc, text) == enc.encode_ordinary(text)
    finally:
        byte_pairs.PART, byte_pairs.LONG_BLANK, byte_pairs._BLANKS = old


def test_long_blank_runs(enc):
    text = "a" + " " * 1_000_000 + "b"
    assert enc.decode_bytes(byte_pairs.encode_text(enc, text)) == text.encode()


def test_bpe_digests(spark, enc):
    got = [tuple(r) for r in queries.bpe_digests(odd_docs(spark)).collect()]
    want = []
    for r in odd_docs(spark).collect():
        text = r["text"] or ""
        ids = enc.encode_ordinary(text)
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert queries.bpe_digests(odd_docs(spark).limit(0)).count() == 0
    ids = byte_pairs.encode(odd_docs(spark), *queries.byte_ranks())
    apart = byte_pairs.decode(ids, *queries.byte_ranks(), keep=("ids",)).collect()
    together = byte_pairs.round_trip(odd_docs(spark), *queries.byte_ranks()).collect()
    assert sorted(map(repr, apart)) == sorted(map(repr, together))


def base_by_rule(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append(("assign", m.start(), m.end()))
    for kind, rule, least in (("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
        found += [(kind, m.start(), m.end()) for m in re.finditer(rule, text) if m.end() - m.start() >= least]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "ToKen", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "9", ":", "=", " ", '"', "é", "secret", "api_key", "ſecret", "\n", "zz"]), max_size=14))
def test_rules_find_what_the_patterns_say(parts):
    text = "".join(parts)
    assert [s[:3] for s in secret_scan.rule_spans(text)] == base_by_rule(text)


def test_automaton_learns_a_format():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    classes = {word(40).translate(secret_scan.TO_CLASS): 1 for _ in range(300)}
    tree = secret_scan.Automaton(classes)
    tree.infer(0.01)
    table = tree.table(classes)
    assert len(table["arcs"]) == 41  # one state per place: the length is part of the format
    rate = lambda w: secret_scan.likelihood(table, w.translate(secret_scan.TO_CLASS)) / len(w)
    assert rate(word(40)) > max(rate(word(39)), rate("9807915762804490"), rate("ordinarylongwordinprose"))


def test_scan_adds_spans_and_keeps_the_rules(spark):
    rng = random.Random(5)
    word = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    key = lambda: "sk" + word("GHIJKLMNOPQRSTUVWXYZ", 22)
    texts = [f"config token = {key()} and prose" for _ in range(200)] + [f"bare {key()} here"] * 2 + ["achlichkeitenunderschaft is a long word, antidisestablishmentarianism"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    formats = secret_scan.learn_formats(docs)
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs, formats).collect()}
    for i, text in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["base"]] == base_by_rule(text)
    assert [(s["start"], s["end"], s["base"]) for s in got[200]] == [(5, 29, False)]
    assert got[200] == got[201] and got[202] == []
    assert secret_scan.redact_text("a key b", [("hex", 2, 5), ("assign", 2, 4)]) == "a [hex] b"


def test_formats_come_from_all_documents(spark):
    """A kind that three of 120,000 documents hold, all outside any half of them taken by the hash of the text."""
    late = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) >= 500_000
    rare = spark.range(200).select(F.concat(F.lit("key "), F.substring(F.sha2(F.col("id").cast("string").cast("binary"), 256), 1, 40)).alias("text")).where(late).limit(3)
    common = spark.range(119_997).select(F.concat(F.lit("ordinarywordinprose "), F.col("id").cast("string")).alias("text"))
    formats = secret_scan.learn_formats(common.union(rare))
    assert list(formats["kinds"]) == ["hex"]
    pairs = Counter(map("".join, itertools.pairwise("$" + "ordinarywordinprose".translate(secret_scan.TO_CLASS) + "$")))
    assert formats["plain"] == secret_scan.plain_table({p: n * 119_997 for p, n in pairs.items()})


def test_examples_do_not_depend_on_partitions(spark):
    docs = spark.range(3000).select(F.concat(F.lit("token="), F.substring(F.sha2(F.col("id").cast("string").cast("binary"), 256), 1, F.col("id").cast("int") % 20 + 6)).alias("text"))
    some, others = (secret_scan.learn_formats(docs.repartition(n), max_examples=30) for n in (2, 9))
    assert some == others and some["kinds"]["assign"]


def spans_beside(text, keys):
    """Where the keys lie in the text."""
    return sorted((text.index(k), text.index(k) + len(k)) for k in keys)


@pytest.mark.parametrize(("chars", "size"), [("0123456789ABCDEF", 40), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 40), ("0123456789", 12)])
def test_keys_attached_to_other_text(spark, chars, size):
    """Keys after a name, in a path and before a full stop, and keys that are shorter than 16 characters."""
    rng = random.Random(11)
    key = lambda: "".join(rng.choice(chars) for _ in range(size))
    prose = "Ordinary words, some/of/them/in-paths.html and CONSTANT_NAMES=values; understanding the remaining documentation."
    keys = [key() for _ in range(7)]
    hidden = [f"export AWS_SECRET_ACCESS_KEY={keys[0]} now", f"see https://host.example.org/get?k={keys[1]}&page=two", f"it is {keys[2]}.", f"var/lib/{keys[3]}/files", f"first.{keys[4]}", f"bare {keys[5]} here", f"token=abcdefgh, next.{keys[6]}"]
    texts = [f"{prose} token = {key()} and so on" for _ in range(300)] + hidden + [prose]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    formats = secret_scan.learn_formats(docs)
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs, formats).collect()}
    # an automaton leaves out the least likely hundredth; an attached key is found as it is alone
    alone = [k for k in keys if [s[1:3] for s in secret_scan.text_spans(k, formats)] == [(0, size)]]
    assert len(alone) >= 5
    for i, (text, k) in enumerate(zip(hidden, keys, strict=True)):
        assert [(s["start"], s["end"]) for s in got[300 + i] if not s["base"]] == spans_beside(text, [k] if k in alone else []), text
    assert got[307] == [] and all(s["base"] for i in range(300) for s in got[i])


def test_rests_are_whole():
    text = "x" * 20 + "token=abcdef" + " " + "y" * 8 + "/AKIA" + "B" * 16 + "-tail-tail token:123456"
    base = secret_scan.rule_spans(text)
    left = "".join(c if not any(a <= i < b for _, a, b, _ in base) else " " for i, c in enumerate(text))
    assert [text[a:b] for a, b in secret_scan.rests(text, base, 6)] == [w for w in left.split() if len(w) >= 6]


def test_secret_queries_on_odd_rows(spark):
    docs = odd_docs(spark)
    formats = secret_scan.learn_formats(docs)
    rows = queries.span_digests(secret_scan.scan(docs, formats)).collect()
    assert sorted(r["n_assign"] for r in rows) == [0] * 6 + [1, 1]
    empty = docs.limit(0)
    assert secret_scan.scan(empty, secret_scan.learn_formats(empty)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<\\|im_start>\nn ab", max_size=12), st.text(alphabet="<\\|im_end>\n ab", max_size=25)), max_size=4))
def test_chats_read_back(turns):
    assert chat_format.read_marked(chat_format.marked(turns)) == turns
    formatted, spans = chat_format.locate(turns, chat_format.marked)
    assert [chat_format.unescape(formatted[a:b]) for _, _, a, b in spans] == [t for _, t in turns]
    assert [s[0] for s in spans] == [0, *[s[1] for s in spans]][: len(spans)]


def test_rewriting_templates_are_found(spark):
    def forgetful(turns):
        """Only the last turn keeps its text."""
        return "".join(f"[{r}]" for r, _ in turns[:-1]) + "".join(f"[{r}]{t}" for r, t in turns[-1:])

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (2, 0, "user", "only")]
    chats = {r["conv_id"]: r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), forgetful).collect()}
    assert chats[1]["rewrites"] and chats[1]["turns"] == [] and not chats[2]["rewrites"]


def test_a_turn_is_escaped_once_however_many_prefixes_it_is_in(monkeypatch):
    seen = []
    monkeypatch.setattr(chat_format, "escape", lambda text, escape=chat_format.escape: seen.append(text) or escape(text))
    turns = [(f"role {i}", f"text <|{i}|>") for i in range(30)]
    formatted, spans = chat_format.locate(turns, chat_format.marked)
    assert formatted == chat_format.marked(turns) and len(spans) == 30
    assert seen[: -2 * 30].count("text <|0|>") == 1 and len(seen) <= 10 * 30


def test_chat_digests_on_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, _conv string, _row string"
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (1, None, None, "sys"), (None, 0, "assistant", "<|im_end|>"), (None, 1, "tool\nx", "")]
    got = {r["conv_id"]: r for r in queries.chat_digests(spark.createDataFrame([(*r, "c", "c") for r in rows], schema)).collect()}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest(("", "sys"), ("user", "q"), ("user", "q"), ("assistant", "")) and got[1]["loss_chars"] == 0
    assert got[None]["turns_sha256"] == digest(("assistant", "<|im_end|>"), ("tool\nx", "")) and got[None]["loss_chars"] == 10
    assert set(got) == {1, None, -1} and got[-1]["loss_sha256"] == hashlib.sha256(b"<|im_end|><|im_start|>assistant ok").hexdigest()
    assert queries.chat_digests(spark.createDataFrame([], schema)).count() == 1


def test_bucket_counts_are_whole():
    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    want = np.zeros(digests.BUCKETS, int)
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        want[((a | b << 8 | c << 16) * int(digests.SPREAD) & 0xFFFFFFFF) >> 24] += 1
    old, digests.STRIDE = digests.STRIDE, 700
    try:
        assert (digests.bucket_counts(data) == want).all()
    finally:
        digests.STRIDE = old
    assert digests.fingerprint_bytes(b"") == digests.fingerprint_bytes(b"")
    prints = [digests.fingerprint_bytes(x) for x in (b"", b"ab", data, data[:4900], b"quite another text " * 30)]
    near = digests.likeness_of([prints[2]] * 5, prints)
    assert near[2] == 1 and near[3] > 0.9 and (near >= 0).all() and (near <= 1).all() and near[4] < near[3]


def test_edited_digests(spark):
    docs = odd_docs(spark).where("doc_id is null or doc_id <> 4").unionByName(spark.createDataFrame([(i, f"text number {i} " * (i % 7), 0, "", "", "") for i in range(20, 90)], ODD))
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r["text"] or "" for r in rows]
    want = []
    for i, (row, text) in enumerate(zip(rows, texts, strict=True)):
        half, nxt = len(text) // 2, texts[(i + 1) % len(texts)]
        edited = text[: len(text) - half] + nxt[:half]
        a, b, c = (digests.fingerprint_bytes(x.encode()) for x in (text, edited, nxt))
        want.append((row["doc_id"], len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, float(digests.likeness_of([a], [b])[0]), float(digests.likeness_of([a], [c])[0])))
    got = [tuple(r) for r in queries.edited_digests(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert queries.edited_digests(docs.limit(0)).count() == 0
    assert queries.edited_digests(docs.where("doc_id = 50")).head()["near_next"] == 1


def test_next_of_large_ids(spark):
    """Ids that are one as doubles follow each other as integers."""
    base = 1 << 53
    ids = [base + i for i in range(60)] + [None, 3, -7, (1 << 62) + 1, 1 << 62]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    ordered = [None, *sorted(i for i in ids if i is not None)]
    want = {i: f"t{n}" for i, n in zip(ordered, [*ordered[1:], ordered[0]], strict=True)}
    for parts in (1, 4, 16):
        got = digests.with_next(rows, "doc_id", ("text",), parts).collect()
        assert len(got) == len(ids) and {r["doc_id"]: r["next_text"] for r in got} == want
