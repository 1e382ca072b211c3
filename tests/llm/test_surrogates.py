import ipaddress
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tunemill.functions import skew
from tunemill.llm import surrogates

TEXTS = [
    "call +1 (743) 555-3824 or 743-555-3824, hosts 10.2.3.4 and 70.23.22.57.",
    "card 4785380592391139, not 4785380592391138; 4785-3805-9239-1139; Re.46@Mail8.example.com re.46@mail8.example.com",
    "Dr. Anna Schmidt met Mr Schmidt; Anna said SCHMIDT is well. Иван Иванов. IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789.",
    None, "", "clean 1.2.3 text, Anna went 2024-01-02 12:30", "schützen.12@mail3.example.com", "Mrs Clara Schmidt",
]


@pytest.fixture(scope="module")
def out(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return {r.doc_id: r for r in surrogates.replace_private(docs, "k").collect()}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_phones_share_one_replacement_in_their_own_formats(out):
    m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}), hosts (10\.\d+\.\d+\.\d+) and (\d+\.\d+\.\d+\.\d+)\.", out[0].text)
    assert m and m.group(1, 2, 3) == m.group(4, 5, 6) and m.group(1, 2, 3) != ("743", "555", "3824")
    assert "70.23.22.57" not in out[0].text and "10.2.3.4" not in out[0].text
    assert (out[0].n_phone, out[0].n_ip) == (2, 2)


def test_cards_keep_check_digits_and_others_stay(out):
    a, b, c = re.findall(r"[0-9-]{16,19}", out[1].text)
    assert luhn(a) and a == c.replace("-", "") and a[0] == "4" and a != "4785380592391139" and b == "4785380592391138"
    x, y = re.findall(r"\S+@\S+", out[1].text)
    assert x == y and re.fullmatch(r"[a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", x)


def test_persons_keep_gender_script_case_and_reference(out):
    m = re.match(r"Dr\. (\w+) (\w+) met Mr (\w+); (\w+) said (\w+) is well\. (\w+) (\w+)\. ", out[2].text)
    assert m[1] == m[4] and m[1] in surrogates.GIVEN["female"].split() and m[1] != "Anna"
    assert m[2] == m[3] and m[5] == m[2].upper() and m[2] != "Schmidt"
    assert m[6] in surrogates.GIVEN["male_cyrillic"].split() and re.fullmatch(r"[А-Я][а-я]+ов", m[7])
    assert out[7].text == f"Mrs {out[7].text.split()[1]} {m[2]}"


def test_account_and_social_security_numbers(out):
    iban = re.search(r"DE[0-9]{2}( [0-9]{4}){4} [0-9]{2}", out[2].text)[0].replace(" ", "")
    assert iban != "DE89370400440532013000" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.search(r"ssn \d{3}-\d{2}-\d{4}\.", out[2].text) and "123-45-6789" not in out[2].text


def test_null_empty_and_clean_texts_stay(out):
    for k in (3, 4, 5):
        assert out[k].text == TEXTS[k] and not out[k].changed
    assert "tzen.12@" not in out[6].text and out[6].n_email == 1


def test_distinct_entities_stay_distinct(spark):
    """Mails of one letter: 26 times 10 shapes for 250 of them, so that most candidates collide."""
    mails = [f"{a}@{b}.io" for a in "abcdefghijklmnopqrstuvwxy" for b in range(10)]
    table = spark.createDataFrame([("email", m) for m in mails] + [("ssn", f"{n:03}-45-6789".replace("-", "")) for n in range(1, 200)], "kind string, canonical string")
    found = surrogates.assign(table, "k").collect()
    by = defaultdict(set)
    for r in found:
        by[r.kind].add(r.replacement)
    assert len(found) == 449 and len(by["email"]) == 250 and len(by["ssn"]) == 199
    assert not by["email"] & set(mails)


def test_table_against_brute_force(spark):
    """The plain forms of the table's own documents, found by the test's own patterns."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    after = {r.doc_id: r.text or "" for r in surrogates.replace_private(docs, "k").collect()}
    assert before.keys() == after.keys()
    plain = [r"[a-z]+\.\d\d@mail\d\.example\.com", r"\+1 \(\d{3}\) 555-\d{4}", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)"]
    to = defaultdict(set)
    for k, old in before.items():
        new = after[k]
        private = [m for p in plain for m in re.findall(p, old)] + [m for m in re.findall(r"(?<![0-9A-Za-z])4\d{15}(?![0-9A-Za-z])", old) if luhn(m)]
        assert not any(m in new for m in private)
        if not private:
            assert new == old
        for p in plain[1:2]:
            for a, b in zip(re.findall(p, old), re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", new), strict=True):
                to[a].add(b)
    assert to and all(len(x) == 1 for x in to.values()) and len({*map(min, to.values())}) == len(to)


def replaced(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in surrogates.replace_private(docs, "k").orderBy("doc_id").collect()]


def test_gender_of_unlisted_names_and_names_by_context(spark):
    a, b, c, d, e = replaced(spark, "Mrs Zelda Khan and Zelda.", "Mr Tobin Khan", "JOHN SMITH met Rajesh Patel.", "My name is Xiu Obrador.", "Κυρία Παπαδοπούλου 王小明先生 田中さん السيد محمود श्री विजय")
    m = re.fullmatch(r"Mrs (\w+) (\w+) and (\w+)\.", a)
    assert m and m[1] == m[3] and m[1].endswith("a") and m[1] != "Zelda" and m[2] != "Khan"
    n = re.fullmatch(r"Mr (\w+) (\w+)", b)
    assert n and n[2] == m[2] and n[1][-1] not in "aeiou" and n[1] != "Tobin"
    g = re.fullmatch(r"([A-Z]+) ([A-Z]+) met (\w+) (\w+)\.", c)
    assert g and g[1].capitalize() in surrogates.GIVEN["male"].split() and g[3] in surrogates.GIVEN["male"].split() and "SMITH" not in c and "Patel" not in c
    assert re.fullmatch(r"My name is [A-Z]\w+ [A-Z]\w+\.", d) and "Xiu" not in d and "Obrador" not in d
    k = re.fullmatch(r"Κυρία ([Α-Ω][α-ω]+) (王\w+)先生 (田\w+)さん السيد (\w+) श्री ([\u0900-\u097f]+)", e)
    assert k and k[1] != "Παπαδοπούλου" and k[2] != "王小明" and k[3] != "田中" and k[4] != "محمود" and k[5] != "विजय"


def test_addresses_keep_range_and_form(spark):
    (a,) = replaced(spark, "2001:db8::1 2001:DB8:0:0:0:0:0:1 2001:0db8:0000:0000:0000:0000:0000:0001 fe80::1ff:fe23:4567:890a std::ab 12:30:45 172.16.4.2 172.32.4.2 127.0.0.1 192.168.1.1 169.254.9.9")
    v = a.split()
    assert re.fullmatch(r"2001:[0-9a-f]{1,4}::[0-9a-f]{1,4}", v[0]) and v[0] != "2001:db8::1"
    assert len({str(ipaddress.ip_address(x)) for x in v[:3]}) == 1 and v[1] == v[1].upper() and len(v[2]) == 39
    assert v[3].startswith("fe80::") and v[3] != "fe80::1ff:fe23:4567:890a" and v[4:6] == ["std::ab", "12:30:45"]
    assert ipaddress.ip_address(v[6]) in ipaddress.ip_network("172.16.0.0/12") and not ipaddress.ip_address(v[7]).is_private
    assert v[8].startswith("127.") and v[9].startswith("192.168.") and v[10].startswith("169.254.")


def test_long_repeats_do_not_fill_the_stack(spark):
    long = ["Mr " + "-".join(["Ab"] * 20_000), "Anna " + "'".join(["Ab"] * 20_000), "a@" + "b." * 50_000 + "com", "DE12" + " ABCD" * 50_000, "+1" + " 22" * 50_000, "2001" + ":1" * 50_000, "Mr " + " ".join(["Ab"] * 20_000), "1." * 50_000, "王" * 50_000]
    got = replaced(spark, *long)
    assert len(got) == len(long) and not got[0].startswith("Mr Ab")


def test_hot_entities_and_texts(spark):
    rows = [(i, "write to a.b@c.org" if i % 2 else f"row {i} a.b@c.org") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = surrogates.replace_private(docs, "k").collect()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(surrogates, "hot_safe_join", lambda a, b, keys, how: skew.hot_safe_join(a, b, keys, how, 50))
        hot = surrogates.replace_private(docs, "k").collect()
    assert sorted(plain) == sorted(hot) and len(hot) == 400 and len({r.text.split()[-1] for r in hot}) == 1


def test_repeated_rows_null_ids_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x@y.org"), (1, "x@y.org"), (None, "x@y.org")], "doc_id long, text string").withColumns({"kind": F.lit(1), "new": F.lit(2), "digest": F.lit(3), "n_email": F.lit(4)})
    rows = surrogates.replace_private(docs, "k").collect()
    assert len(rows) == 3 and len({r.text for r in rows}) == 1 and rows[0].text != "x@y.org"
    assert surrogates.replace_private(docs.limit(0), "k").count() == 0


def test_very_long_text(spark):
    text = "word " * 200_000 + "a.b@c.org " + "1" * 100_000 + " " + "A" * 100_000
    r = surrogates.replace_private(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert len(r.text) == len(text) and r.n_email == 1 and "a.b@c.org" not in r.text
