from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from ledgerlark.llm import pii
from tests.llm.helpers import DOCS, awkward, empty

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return True


def plain_base(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(BASE)
             for m in re.finditer(BASE[kind], text or "") if passes(kind, m[0])]
    return sorted(found)


TEXTS = [
    "mail a@b.cd@e.fg and a@b.c%d@e.fg then x@y and z@z.z.",
    "\U0001f600 é ip 1.2.3.4 001.002.3.255 256.1.1.1 1.2.3.4.5.6.7.8 9.9.9",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111 378282246310005",
    "call +1 (988) 555-2485 or +49 30 1234567. +1 2 +1234567890123456 +",
    "+1 4111 1111 1111 1111 a@1.2.3.4",
    "1 " * 20000,
    "7" * 50000,
    "a" * 50000 + "@" + "b" * 50000,
    "a.b@c-d.e-f.g h@i..j @k.l m@-.-",
    "5500005555555559 5500 0055 5555 5559 0000000000000",
]


def test_base_spans_against_plain_regex(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], DOCS)
    docs = docs.unionByName(awkward(spark).select(docs.columns))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    rows = pii.personal_data(docs).collect()
    want = []
    for r in docs.collect():
        base = plain_base(r.text)
        listed = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in base)
        want.append((r.doc_id, *[sum(x[1] == k for x in base) for k in range(4)],
                     hashlib.sha256(listed.encode()).hexdigest(), listed))
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(texts) <= len(rows)


def learning_docs(spark):
    rows = [(i, f"word{i} phone: +1 (988) 555-24{i:02d} some more of the text", "en", "s", 1) for i in range(10)]
    rows += [(20, "my phone: 0988-555-2485 here", "en", "s", 1), (21, "then 0988-555-2485 again", "en", "s", 1),
             (22, "the 0988-555-9999 the", "en", "s", 1)]
    rows += [(30 + i, f"the +1 (988) 555-24{i:02d} is the one", "en", "s", 1) for i in range(4)]
    rows += [(40 + i, "the of the and the", "en", "s", 1) for i in range(10)]
    return spark.createDataFrame(rows, DOCS)


def test_patterns_discover_unseen_identifiers(spark):
    rows = {r.doc_id: r for r in pii.personal_data(learning_docs(spark)).collect()}
    assert rows[20].spans == "phone:10:23" and rows[20].n_phone == 0 and rows[20].n_found == 1
    assert rows[21].spans == "phone:5:18"
    assert rows[22].spans == ""


def chain_docs(spark, hops):
    """Each trigger shares three numbers with the one before; only the first stands before base spans."""
    number = lambda hop, k: f"0{hop}88-555-24{k:02d}"
    name = lambda hop: "abcdefgh"[hop] + "-line:"
    rows = [f"w{k} {name(0)} +1 (988) 555-24{k:02d} end" for k in range(12)]
    for hop in range(hops):
        rows += [f"w{k} {name(hop)} {number(hop, k)} end" for k in range(3)]
        rows += [f"w{k} {name(hop + 1)} {number(hop, k)} end" for k in range(3)]
    rows.append(f"w {name(hops)} 0999-555-9999 end")
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], DOCS)


def test_discovered_identifiers_induce_patterns(spark):
    rows = pii.personal_data(chain_docs(spark, 1)).collect()
    assert all(r.spans for r in rows) and sum(r.n_found for r in rows) == 7


def test_unseen_values_and_longer_chains_do_not_lower_trust(spark):
    rows = [(i, f"w{i} phone: +1 (988) 555-24{i:02d} end", "en", "s", 1) for i in range(4)]
    rows += [(10 + i, f"w{i} phone: 0988-555-24{i:02d} end", "en", "s", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS)
    assert all(r.spans for r in pii.personal_data(docs).collect())
    assert all(r.spans for r in pii.personal_data(chain_docs(spark, 4)).collect())


def test_identifiers_of_several_tokens_and_patterns_of_several_words(spark):
    rows = [(i, f"w{i} phone: +1 (988) 555-24{i:02d} or so", "en", "s", 1) for i in range(6)]
    rows += [(10 + i, f"w{i} number is +1 (988) 555-24{i:02d} or so", "en", "s", 1) for i in range(6)]
    rows += [(20 + i, "all is well and this is so, which is it", "en", "s", 1) for i in range(20)]
    new = ["phone: (988) 555-2485 ok", "phone: 0161 496 0000, ok", "phone: (0988-555-2485) ok",
           "phone: DE89 3704 0044 0532 0130 00 ok", "phone: 0988-555-9999 0988-555-8888 ok",
           "number is 0988-555-7777 ok", "this is 0988-555-6666 ok"]
    rows += [(100 + i, t, "en", "s", 1) for i, t in enumerate(new)]
    out = {r.doc_id: r.text for r in pii.masked(spark.createDataFrame(rows, DOCS)).collect()}
    assert [out[100 + i] for i in range(len(new))] == [
        "phone: [PHONE] ok", "phone: [PHONE], ok", "phone: ([PHONE]) ok", "phone: [PHONE] ok",
        "phone: [PHONE] [PHONE] ok", "number is [PHONE] ok", "this is 0988-555-6666 ok"]


def test_masking(spark):
    docs = learning_docs(spark).unionByName(
        spark.createDataFrame([(90, "x 1.2.3.4 y a@b.cd +1 988 555 2485 1.1.1.1", "en", "s", 7)], DOCS)
    )
    rows = {r.doc_id: r for r in pii.masked(docs).collect()}
    assert rows[0].text == "word0 phone: [PHONE] some more of the text"
    assert rows[20].text == "my phone: [PHONE] here" and rows[20].n_chars == len(rows[20].text)
    assert rows[22].text == "the 0988-555-9999 the" and rows[22].n_chars == 1
    assert rows[90].text == "x [IP] y [EMAIL] [PHONE]"
    strange = awkward(spark)
    assert pii.masked(strange).columns == strange.columns
    assert pii.masked(strange).count() == strange.count()


def test_empty(spark):
    assert pii.personal_data(empty(spark)).count() == 0
    assert pii.masked(empty(spark)).count() == 0


def test_a_failed_number_is_no_address(spark):
    rows = [(i, f"mail w{i}@b.cd and e{i}@f.gh then", "en", "s", 1) for i in range(6)]
    rows += [(50, "card 4111 1111 1111 1111 and 4111-1111-1111-1112 then", "en", "s", 1), (51, "w and x9@y then", "en", "s", 1)]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[50].spans == "card:5:24" and out[50].n_card == 1
    assert out[51].spans in ("", "email:6:10")


def test_words_at_the_edge_of_the_context_are_whole(spark):
    """The words before a match count whole, however long they are."""
    long = "q" * 200
    rows = [(i, f"{'x' * i} {long}phone: +1 (988) 555-24{i:02d} end", "en", "s", 1) for i in range(8)]
    rows += [(50, f"w {long}phone: 0988-555-2485 end", "en", "s", 1), (51, f"w {long[:150]}phone: 0988-555-2486 end", "en", "s", 1)]
    out = {r.doc_id: r.n_found for r in pii.personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    assert (out[50], out[51]) == (1, 0)


def test_masking_takes_time_in_proportion_and_keeps_columns(spark):
    n = 500
    text = " ".join(f"é{i % 7} a{i}@b.cd" for i in range(n)) + " \U0001f600"
    plain = spark.createDataFrame([(1, text, "en", "s", 1), (2, None, "en", "s", 1), (3, "a@b.cd", "en", "s", 1)], DOCS)
    docs = plain.selectExpr("*", *(f"doc_id as {name}" for name in ("_cuts", "_masked", "_row_file", "_row_place", "_blocks", "`a.b`")))
    out = {r.doc_id: r for r in pii.masked(docs).collect()}
    assert out[1].text == " ".join(f"é{i % 7} [EMAIL]" for i in range(n)) + " \U0001f600"
    assert out[1].n_chars == len(out[1].text) and out[3].text == "[EMAIL]" and out[2].text is None
    assert pii.masked(docs).columns == docs.columns and all(r["_cuts"] == r["a.b"] == d for d, r in out.items())
    assert pii.personal_data(docs).count() == 3


def test_blocks_against_slices(spark):
    text = "".join(chr(97 + i % 26) if i % 50 else "\U0001f600" for i in range(3000))
    cuts = [(0, 0), (0, 5), (511, 512), (512, 512), (500, 513), (0, 1024), (1023, 2049), (5, 3000), (2999, 3000), (3000, 3000), (1024, 3072)]
    frame = spark.createDataFrame([(text, a, b) for a, b in cuts], "text string, a int, b int")
    blocks = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{pii.BLOCK}}}"), F.lit(0))
    for row in frame.select("a", "b", pii._between(blocks, F.col("a"), F.col("b")).alias("part")).collect():
        assert row.part == text[row.a : row.b]
