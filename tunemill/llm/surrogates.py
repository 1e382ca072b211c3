"""Surrogates for personal data: keyed, type-consistent replacements, by DataFrame functions alone.

One pattern finds e-mail and IP addresses, card, account, social-security and telephone numbers, and persons: a
title, a listed given name or a phrase like "name is" before capitalised names; in Chinese, Japanese, Arabic and
Devanagari a name beside a title. A given name that is not listed, after a title that shows the gender, gets a word of
that gender's form. Each entity has a canonical form (digits without
punctuation, lower-case letters), so that one person or number written in two ways gets one replacement. A
candidate is a keyed SHA-256 of kind, canonical form and attempt, put into the entity's own shape. All entities of
the corpus then meet in one table: a candidate that another entity holds, or that is itself an entity of the
corpus, is refused and its entity tries again, so distinct entities stay distinct.

Each text is searched once; what was found is written with it. Texts that hold an entity are cut by the same pattern
and put together again around the replacements, and only these are shuffled.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunemill.functions.skew import hot_safe_join
from tunemill.session import written

KINDS = ("email", "ip", "ip6", "card", "iban", "ssn", "phone", "person")

# Given names by gender and script, titles by the gender that they show, and the syllables of each script.
GIVEN = {
    "female": "Anna Maria Mary Elizabeth Jennifer Linda Susan Jessica Sarah Karen Lisa Nancy Emily Laura Julia Sophie Claire Camille Isabel Carmen Lucia Elena Sofia Katharina Sabine Petra Monika Ursula Ingrid Chloe Amelia Olivia Hannah Alice Priya Ananya Fatima Aisha Yuki Mei Amina Ngozi",
    "male": "John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Paul Andrew Peter Hans Klaus Stefan Jürgen Wolfgang Pierre Jean Luc François Antoine Carlos José Luis Miguel Javier Pablo George Henry Rajesh Amit Mohammed Ahmed Hiroshi Wei Kwame Chinedu",
    "female_cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия",
    "male_cyrillic": "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Павел",
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Señora Sra Κυρία Госпожа",
    "m": "Mr Herr Monsieur Señor Sr Sir Κύριος Господин",
    "": "Dr Prof",
}
#: Titles of scripts without capitals, before a name, and after one; family names that begin one before such a title.
TITLES_BEFORE, TITLES_AFTER = "السيد السيدة श्री श्रीमती", "先生 女士 小姐 さん 様 氏"
FAMILY_HAN = "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林 何 郭 马 罗 田中 佐藤 鈴木 高橋 伊藤 渡辺 山本 中村 小林 加藤"
#: What stands before a name that is introduced.
PHRASES = ("name is ", "Name: ", "name: ")
SYLLABLES = {
    "Cyrillic": ("бвгдзклмнпрстфжш", "аеиоуаеиоуаеиоуа"),
    "Greek": ("βγδζθκλμνξπρστφχ", "αειουαειουαειουα"),
    "Han": ("明文华建国志海伟军平安宁晨光德永", "美英秀玉兰芳静敏丽雪梅春月云霞清"),
    "Arabic": ("بتجحدرزسشصطفقكلم", "اوياوياوياوياويا"),
    "Devanagari": ("कगचजटडतदनपबमरलवस", "ािीुूेोौािीुूेोौ"),
}
_CONSONANTS, _VOWELS = "bcdfghklmnprstvz", "aeiouaeiouaeioua"
_HEX = "0123456789abcdef"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_H16 = "[0-9A-Fa-f]{1,4}"
# Repeats are possessive or bounded: Java's matcher would keep a stack frame for each turn of another.
_NAME = r"\p{Lu}\p{L}++(?:[-']\p{Lu}\p{L}++){0,7}+"
_WORD = r"\p{Lu}\p{L}++|\p{IsHan}++|[\p{IsArabic}\p{IsDevanagari}]++"
_LISTED = "|".join(x for names in GIVEN.values() for n in names.split() for x in (n, n.upper()))
_either = lambda words: "|".join(words.split())
_UNCASED = rf"(?:{_either(FAMILY_HAN)})\p{{IsHan}}{{0,2}}?(?={_either(TITLES_AFTER)})|(?<=(?:{_either(TITLES_BEFORE)}) )(?:\p{{IsArabic}}++|\p{{IsDevanagari}}++)"
_TITLES = " ".join(TITLES.values())
# The patterns of the kinds, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9_][\p{L}0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ip6": rf"(?<![\p{{L}}0-9:.])(?:[23][0-9A-Fa-f]{{3}}|[Ff][C-Fc-f][0-9A-Fa-f]{{2}})(?:(?::{_H16}){{7}}|(?::{_H16}){{0,6}}::(?:{_H16}(?::{_H16}){{0,5}})?)(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[2-6][0-9]{12,18}|[2-6][0-9]{3}[ -][0-9]{4}(?:[ -][0-9]{4}){1,2}(?:[ -][0-9]{1,4})?|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|(?:1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9])",
    "person": rf"(?<!\p{{L}})(?:(?:{_either(_TITLES)})\.? {_NAME}(?: {_NAME}){{0,2}}|(?:{_LISTED})(?: \p{{Lu}}\.)? {_NAME}|(?<={'|'.join(PHRASES)}){_NAME}(?: {_NAME}){{1,2}})(?!\p{{L}})|{_UNCASED}",
}
#: All of them; a look at one character first, since most places begin with a small letter.
_ANY = rf"{PATTERNS['email']}|(?=[0-9(+])(?:{'|'.join(PATTERNS[k] for k in ('ip', 'ip6', 'card', 'ssn', 'phone'))})|(?=[Ff]){PATTERNS['ip6']}|(?=\p{{Lu}})(?:{PATTERNS['iban']}|{PATTERNS['person']})|(?=\p{{Lo}})(?:{_UNCASED})"
#: Attempts after which the space of replacements of a shape counts as full; those that can grow do so from WIDEN on.
ATTEMPTS, WIDEN = 60, 3


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    return F.split(x, "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of a card number's digits, every second from the right doubled (9 less if over 9)."""
    turned = F.transform(_chars(F.reverse(digits)), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(turned, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _mod97(iban: Column) -> Column:
    """The account number modulo 97, country and check digits moved to its end and letters read as 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(turned), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _groups(address: Column) -> Column:
    return F.filter(F.split(address, ":"), lambda g: g != "")


def _whole_ip6(match: Column) -> Column:
    """All eight groups of four digits."""
    left, right = F.substring_index(match, "::", 1), F.when(F.contains(match, F.lit("::")), F.substring_index(match, "::", -1)).otherwise("")
    some = F.size(_groups(left)) + F.size(_groups(right))
    groups = F.concat(_groups(left), F.array_repeat(F.lit("0"), F.greatest(8 - some, F.lit(0))), _groups(right))
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(g), 4, "0")), ":")


def _like_ip6(whole: Column, match: Column) -> Column:
    """An address of eight groups, written as match is: its leading zeros, its gap and its case."""
    short = F.when(match.rlike("(^|:)0[0-9A-Fa-f]"), whole).otherwise(F.regexp_replace(whole, "(^|:)0{1,3}", "$1"))
    gap = F.when(F.contains(match, F.lit("::")), F.regexp_replace(short, "^(.*?)(?::0{1,4})+(?=:|$)", "$1:")).otherwise(short)
    gap = F.when(gap.endswith(":"), F.concat(gap, F.lit(":"))).otherwise(gap)
    return F.when(match.rlike("[A-F]"), F.upper(gap)).otherwise(gap)


def _kind(match: Column) -> Column:
    """The kind of a match; null if its check digits show that it is another thing."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    is_kind = {k: match.rlike(f"^(?:{p})$") for k, p in PATTERNS.items() if k != "person"}
    is_kind["person"] = match.rlike(r"^[\p{Lu}\p{Lo}][\p{L}\p{M}.' -]*+$")  # what stood around it is not here
    is_kind["card"] &= (_luhn_sum(_digits(match)) % 10 == 0) & F.length(_digits(match)).between(13, 19)
    is_kind["iban"] &= _mod97(plain) == 1
    is_kind["ip6"] &= ~F.contains(match, F.lit("::")) | (F.size(_groups(match)) <= 7)
    is_kind["phone"] &= F.length(_digits(match)).between(7, 15)
    return F.coalesce(*(F.when(is_kind[k], F.lit(k)) for k in ("email", "ip", "ip6", "iban", "card", "ssn", "phone", "person")))


def _names(match: Column) -> Column:
    return F.regexp_extract_all(match, F.lit(_WORD), 0)


def _canonical(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    phone = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substr(digits, F.lit(2))).otherwise(digits)
    return F.when(kind == "email", F.lower(match)).when(kind == "ip", match).when(kind == "ip6", _whole_ip6(match)).when(kind == "iban", F.replace(match, F.lit(" "), F.lit(""))).when(kind == "phone", phone).otherwise(digits)


def _next_given(key: str) -> dict[str, str]:
    """Each listed name's replacement: the next one of its gender and script in keyed order, so none stays and none meet."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names.split(), key=lambda n: hashlib.sha256(f"{key}:given:{n}".encode()).digest())
        out |= {a.lower(): b.lower() for a, b in zip(order, order[1:] + order[:1], strict=True)}
    return out


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _entities(kind: Column, match: Column) -> Column:
    """array of (kind, canonical form, gender) that need a replacement of their own; listed given names and titles do not.

    The gender (f, m or empty) is that of a title before a given name and a family name, for the given name."""
    given = [n.lower() for names in GIVEN.values() for n in names.split()]
    titles = {t.lower(): g for g, words in TITLES.items() for t in words.split()}
    words = F.filter(F.transform(_names(match), F.lower), lambda n: ~n.isin(list(titles)))
    gender = F.coalesce(_literal_map(titles)[F.lower(F.regexp_extract(match, r"^\p{L}+", 0))], F.lit(""))
    item = lambda k, c, g: F.struct(k.alias("kind"), c.alias("canonical"), g.alias("gender"))
    new = F.filter(words, lambda n: ~n.isin(given))
    persons = F.transform(new, lambda n: item(F.lit("person"), n, F.when((F.size(words) >= 2) & (n == F.get(words, 0)), gender).otherwise("")))
    none = F.array().cast("array<struct<kind:string,canonical:string,gender:string>>")
    return F.when(kind == "person", persons).when(kind.isNotNull(), F.array(item(kind, _canonical(kind, match), F.lit("")))).otherwise(none)


def _in_shape(canonical: Column, stream: Column) -> Column:
    """canonical with each letter and digit replaced from a stream of hex digits; all else stays."""
    at = lambda i: F.substr(stream, i % 128 + 1, F.lit(1))
    return F.array_join(F.transform(_chars(canonical), lambda c, i: F.when(c.rlike("[0-9]"), F.translate(at(i), "abcdef", "274953")).when(c.rlike(r"\p{Ll}"), F.translate(at(i), _HEX, _CONSONANTS[:8] + "aeiouwxy")).when(c.rlike(r"\p{Lu}"), F.upper(F.translate(at(i), _HEX, _CONSONANTS[:8] + "aeiouwxy"))).otherwise(c)), "")


def _syllables(stream: Column, n: Column, consonants: str, vowels: str) -> Column:
    """A word of n letters, consonants and vowels in turn."""
    at = lambda i: F.substr(stream, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i % 2 == 1, F.translate(at(i), _HEX, consonants)).otherwise(F.translate(at(i), _HEX, vowels))), "")


def candidate(key: str, kind: Column, canonical: Column, attempt: int, gender: Column) -> Column:
    """The replacement, in canonical form, that an entity asks for at an attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canonical, F.lit(str(attempt)))
    stream = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f2")), 256))
    shaped = _in_shape(canonical, stream)
    wider = 2 * max(0, attempt - WIDEN)
    more = _syllables(F.reverse(stream), F.lit(wider), _CONSONANTS, _VOWELS) if wider else F.lit("")

    domain, local = F.substring_index(canonical, "@", -1), F.substring_index(canonical, "@", 1)
    labels = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256)
    host = F.concat(_in_shape(F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.concat(labels, labels)), F.lit("."), F.substring_index(domain, ".", -1))
    email = F.concat(F.substr(shaped, F.lit(1), F.length(local)), more, F.lit("@"), host)

    byte = lambda i: F.conv(F.substr(stream, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")
    tail = lambda k: F.concat_ws(".", *(byte(i).cast("string") for i in range(4 - k, 4)))
    # private, loopback and link-local addresses stay in their range
    kept = [("10.", 3), ("127.", 3), ("192.168.", 2), ("169.254.", 2)]
    ip = reduce(lambda w, x: w.when(canonical.startswith(x[0]), F.concat(F.lit(x[0]), tail(x[1]))), kept, F.when(canonical.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."), F.concat_ws(".", F.lit("172"), (16 + byte(4) % 16).cast("string"), tail(2))))
    ip = ip.otherwise(F.concat_ws(".", (11 + byte(4) % 89).cast("string"), tail(3)))
    group = lambda g, i: F.when((i == 0) | ((g == "0000") & ((i < 4) | F.lit(attempt <= WIDEN))), g).otherwise(F.regexp_replace(F.substr(stream, 4 * i + 1, F.lit(4)), "^0000$", "0001"))
    ip6 = F.array_join(F.transform(F.split(canonical, ":"), group), ":")

    first = F.substr(canonical, F.lit(1), F.lit(1))
    body = F.concat(first, F.substr(shaped, F.lit(2), F.length(canonical) - 2))
    card = F.concat(body, ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))

    country, account = F.substr(canonical, F.lit(1), F.lit(2)), F.substr(shaped, F.lit(5))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)

    lead = F.translate(F.substr(stream, F.lit(100), F.lit(1)), _HEX, "2345678923456789")
    ssn = F.concat(F.translate(F.substr(stream, F.lit(100), F.lit(1)), _HEX, "1234578123457812"), F.regexp_replace(F.substr(shaped, F.lit(2)), "^(..)00", "$101"))
    ssn = F.regexp_replace(ssn, "0000$", "0001")
    phone = F.when(F.length(canonical) == 10, F.concat(lead, F.substr(shaped, F.lit(2)))).otherwise(F.concat(F.substr(canonical, F.lit(1), F.lit(2)), F.substr(shaped, F.lit(3))))

    n = F.lit(8 + wider)
    ending = F.regexp_extract(canonical, "(ов|ев|ин|ова|ева|ина|ская|ский)$", 1)
    latin = F.when(gender == "f", F.concat(_syllables(stream, n - 1, _CONSONANTS, _VOWELS), F.lit("a"))).when(gender == "m", _syllables(stream, n - 1, _CONSONANTS, _VOWELS)).otherwise(_syllables(stream, n, _CONSONANTS, _VOWELS))
    person = F.when(canonical.rlike(r"^\p{IsCyrillic}"), F.concat(_syllables(stream, n - 1, *SYLLABLES["Cyrillic"]), ending))
    person = person.when(canonical.rlike(r"^\p{IsHan}"), F.concat(F.substr(canonical, F.lit(1), F.lit(1)), _syllables(stream, F.greatest(F.length(canonical) - 1, F.lit(2)) + wider, *SYLLABLES["Han"])))
    person = reduce(lambda w, x: w.when(canonical.rlike(rf"^\p{{Is{x}}}"), _syllables(stream, n, *SYLLABLES[x])), ("Greek", "Arabic", "Devanagari"), person).otherwise(latin)
    return reduce(lambda w, x: w.when(kind == x[0], x[1]), [("ip", ip), ("ip6", ip6), ("card", card), ("iban", iban), ("ssn", ssn), ("phone", phone), ("person", person)], F.when(kind == "email", email))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, canonical, replacement for each of the distinct entities (kind, canonical[, gender]); no two of a kind share one.

    A candidate is refused if it is the form of an entity of the table or was given before; of those that ask for
    the same one, the smallest form gets it. The refused ask again until none is left.
    """
    pending = entities if "gender" in entities.columns else entities.withColumn("gender", F.lit(""))
    done: DataFrame | None = None
    for attempt in range(ATTEMPTS):
        asked = pending.withColumn("replacement", candidate(key, F.col("kind"), F.col("canonical"), attempt, F.col("gender")))
        taken = entities.select("kind", F.col("canonical").alias("replacement"))
        taken = taken if done is None else taken.unionByName(done.select("kind", "replacement"))
        free = asked.join(taken, ["kind", "replacement"], "left_anti")
        won = written(free.groupBy("kind", "replacement").agg(F.min("canonical").alias("canonical")).select("kind", "canonical", "replacement"), "surrogates")
        done = won if done is None else done.unionByName(won)
        pending = written(pending.join(won.select("kind", "canonical"), ["kind", "canonical"], "left_anti"), "refused")
        if pending.isEmpty():
            return done
    raise ValueError(f"after {ATTEMPTS} attempts some entities have no replacement: as many exist as their shape allows")


def _filled(match: Column, symbols: Column, slot: str) -> Column:
    """match with its slots (characters of a class) filled from the right by symbols; slots beyond them stay."""
    gaps, own = F.split(match, slot, -1), F.regexp_extract_all(match, F.lit(f"({slot})"), 1)
    n = F.size(own)
    full = F.concat(F.slice(own, F.lit(1), F.greatest(n - F.length(symbols), F.lit(0))), _chars(symbols))
    return F.array_join(F.zip_with(gaps, full, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")


def _cased(name: Column, like: Column) -> Column:
    return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(name)).otherwise(F.concat(F.upper(F.substr(name, F.lit(1), F.lit(1))), F.substr(name, F.lit(2))))


def _replace_names(x: Column, names: Column) -> Column:
    """x with its words that are names replaced, capitalised ones and those of scripts without capitals; the case of each stays."""
    new = F.transform(_names(x), lambda w: F.coalesce(_cased(names[F.lower(w)], w), w))
    return F.array_join(F.zip_with(F.split(x, _WORD, -1), new, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with its personal data replaced, n_<kind> for each of KINDS (long), changed; one row per document.

    Null text stays null and counts nothing. Ids may be null or repeat; other columns are not read. Equal entities
    get equal replacements over the whole table, distinct ones distinct replacements, and a rerun with the same key and
    table the same ones. In a document that names a person, its listed given names and that person's surname are
    replaced wherever they stand capitalised. Long texts are read whole. Raises ValueError if ATTEMPTS attempts leave
    an entity without a replacement. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = {k: f"n_{k}" for k in KINDS}
    found = F.transform(F.coalesce(F.regexp_extract_all("text", F.lit(_ANY), 0), F.array().cast("array<string>")), lambda m: F.struct(m.alias("value"), _kind(m).alias("kind")))
    marked = rows.withColumn("matches", found).withColumn("held", F.size("matches") > 0)
    marked = written(marked.withColumn("digest", F.when(F.col("held"), F.sha2("text", 256))), "marked", by="held")
    clean = marked.filter("not held").select("doc_id", "text", *(F.lit(0).cast("long").alias(c) for c in counts.values()), F.lit(False).alias("changed"))

    hit = marked.filter("held").select("doc_id", "text", "matches", "digest")
    listed = F.flatten(F.transform("matches", lambda m: _entities(m["kind"], m["value"])))
    spans = written(hit.select("digest", F.explode(F.array_distinct(listed)).alias("e")).select("digest", "e.*").distinct(), "entities")
    shown = F.when(F.col("gender") != "", F.col("gender"))
    distinct = spans.groupBy("kind", "canonical").agg(F.when(F.min(shown) == F.max(shown), F.min(shown)).alias("gender"))
    given = assign(written(distinct.withColumn("gender", F.coalesce("gender", F.lit(""))), "distinct"), key)

    label = lambda kind, canonical: F.concat(kind, F.lit(":"), canonical)
    replaced = hot_safe_join(spans.select("digest", "kind", "canonical").distinct(), given, ["kind", "canonical"], "inner")
    new = replaced.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct(label(F.col("kind"), F.col("canonical")), F.col("replacement")))).alias("new"))
    new = written(new, "replacements")

    whole = hot_safe_join(hit, new, ["digest"], "left").withColumn("new", F.coalesce("new", F.create_map().cast("map<string,string>")))
    persons = F.map_filter("new", lambda k, _: k.startswith("person:"))
    names = F.map_concat(F.transform_keys(persons, lambda k, _: F.substr(k, F.lit(8))), F.map_filter(_literal_map(_next_given(key)), lambda k, _: ~F.map_contains_key("new", F.concat(F.lit("person:"), k))))
    whole = whole.withColumn("names", F.when(F.exists("matches", lambda m: m["kind"] == "person"), names))

    def put(m: Column) -> Column:
        value, kind = m["value"], m["kind"]
        to = F.col("new")[label(kind, _canonical(kind, value))]
        return (
            F.when(kind == "person", _replace_names(value, F.col("names")))
            .when(kind == "ip", to)
            .when(kind == "ip6", _like_ip6(to, value))
            .when(kind == "email", F.when(value == F.upper(value), F.upper(to)).otherwise(to))
            .when(kind == "iban", _filled(value, to, "[A-Z0-9]"))
            .when(kind.isNotNull(), _filled(value, to, "[0-9]"))
            .otherwise(value)
        )

    gaps = F.split("text", _ANY, -1)
    gaps = F.when(F.col("names").isNotNull(), F.transform(gaps, lambda g: _replace_names(g, F.col("names")))).otherwise(gaps)
    text = F.array_join(F.zip_with(gaps, F.transform("matches", put), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    kinds = F.col("matches")["kind"]
    n = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(c) for k, c in counts.items()]
    return whole.select("doc_id", text.alias("text"), *n, F.exists("matches", lambda m: m["kind"].isNotNull()).alias("changed")).unionByName(clean)
