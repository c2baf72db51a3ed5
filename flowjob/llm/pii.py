"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.  DataFrame functions only.

Base kinds (email, ip, card, phone) are confirmed by their own rules and always
reported.  Further kinds are scored: a proposal's own score, raised where its
checksum holds and where a word of its context stands in the `CONTEXT` characters
before or after it; from `THRESHOLD` on it is reported, unless it overlaps a base span.

The patterns are those of the contract, guarded so that each run of characters is
tried once, however long it is: a match can only begin where a run begins or where
the match before ended (``\\G``), and repetitions that nothing follows are possessive,
so that no run, however long, deepens the stack.  Positions come from the lengths of matches and of
the pieces between them, in code points.

Defined results: a null text is an empty one and has no spans; each row is judged
by itself, whatever its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT, THRESHOLD = 40, 0.75

_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Maximal runs of digits with single separators, of 13 to 19 digits; longer and shorter runs are no cards.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an account number by country: the registry's, then those in use outside it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
for _n, _more in {25: "AO CV GW MZ", 26: "DZ IR", 27: "CF CG CM GA GQ KM MG TD", 28: "BF BJ CI MA ML NE SN TG"}.items():
    IBAN_LENGTHS[_n] = f"{IBAN_LENGTHS[_n]} {_more}"
_COUNTRY = f"(?:{'|'.join(c for v in IBAN_LENGTHS.values() for c in v.split())})"
_FIXED = "|".join(rf"(?:{v.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, v in IBAN_LENGTHS.items())
#: A known country's length is exact; another's number ends before a known country's begins, and account() finds its end.
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_FIXED}|(?!{_COUNTRY})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_COUNTRY}[0-9]{{2}})\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
TEL = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"

#: kind: pattern, own score, gain of a checksum, gain of context, context words
SCORED = {
    "iban": (IBAN, 0.4, 0.4, 0.2, r"(?i)\b(iban|konto|account|bank|bic|swift|compte|cuenta)\b"),
    "ssn": (SSN, 0.4, 0.0, 0.4, r"(?i)\b(ssn|social security|sozialversicherung)\b"),
    "tel": (TEL, 0.4, 0.0, 0.4, r"(?i)\b(tel|phone|telephone|call|mobile|fax|telefon|t[eé]l[eé]fono?)\b"),
}


def found(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: the leftmost non-overlapping matches with their places."""
    re = F.lit(pattern)
    matches = F.regexp_extract_all(text, re, 0)
    both = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.length(gap).alias("g"), F.length(m).alias("n"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        return F.when(x["m"].isNull(), acc).otherwise(F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["m"].alias("m")))).alias("out")))

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return F.when(F.regexp_like(text, re), F.aggregate(both, start, step, lambda acc: acc["out"])).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, n - i + 1, F.lit(1))) - 48
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, its country and check digits moved to the end, is 1 modulo 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(c < 65, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def account(x: Column) -> Column:
    """A proposed account number; one of no known country is cut to its longest part that ends at a space and passes mod97, if there is one."""
    m = x["m"]
    ends = F.filter(F.sequence(F.lit(15), F.length(m)), lambda i: (F.substr(m, i, F.lit(1)) != " ") & F.substr(m, i + 1, F.lit(1)).isin("", " ") & mod97(F.regexp_replace(F.substr(m, F.lit(1), i), " ", "")))
    n = F.coalesce(F.array_max(ends), F.length(m))
    return F.when(F.regexp_like(m, F.lit(f"^{_COUNTRY}")), x).otherwise(F.struct(x["s"].alias("s"), (x["s"] + n).alias("e"), F.substr(m, F.lit(1), n).alias("m")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _base() -> dict[str, tuple[str, object]]:
    return {
        "email": (EMAIL, None),
        "ip": (IP, lambda x: F.forall(F.split(x["m"], r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))),
        "card": (CARD, lambda x: luhn(_digits(x["m"]))),
        "phone": (PHONE, lambda x: F.length(_digits(x["m"])).between(9, 15)),
    }


def spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, email, ip, card, phone and the further kinds, each array<struct<s, e, m>>, s and e in code points, e exclusive."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = _base()
    out = docs.select("*", *(found(F.col("text"), p).alias(k) for k, (p, _) in base.items()), *((F.transform(f, account) if k == "iban" else f).alias(k) for k, v in SCORED.items() for f in [found(F.col("text"), v[0])]))
    out = out.select("doc_id", "text", *((F.filter(k, ok) if ok else F.col(k)).alias(k) for k, (_, ok) in base.items()), *SCORED)
    taken = F.concat(*base)

    def reported(kind: str) -> Column:
        _, own, checksum, context, words = SCORED[kind]

        def keep(x: Column) -> Column:
            score = F.lit(own)
            if checksum:
                score = score + F.when(mod97(F.regexp_replace(x["m"], "[^A-Z0-9]", "")), checksum).otherwise(0.0)
            near = F.substr(F.col("text"), F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
            after = F.substr(F.col("text"), x["e"] + 1, F.lit(2 * CONTEXT))  # a word that begins in CONTEXT characters is there in full
            score = score + F.when(F.regexp_like(near, F.lit(words)) | F.regexp_like(after, F.lit(rf"^[\s\S]{{0,{CONTEXT - 1}}}{words}")), context).otherwise(0.0)
            return (score >= THRESHOLD) & ~F.exists(taken, lambda t: (t["s"] < x["e"]) & (x["s"] < t["e"]))

        return F.filter(kind, keep)

    return out.select("doc_id", *base, *(reported(k).alias(k) for k in SCORED))


def digest(found_spans: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    base = list(_base())

    def named(kinds: list[str]) -> Column:
        def one(k: str) -> Column:
            return F.transform(k, lambda x: F.concat(F.lit(f"{k}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))

        return F.array_join(F.concat(*(one(k) for k in kinds)), ",")

    return found_spans.select("doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in base), F.sha2(named(base), 256).alias("base_sha256"), named([*base, *SCORED]).alias("spans"))
