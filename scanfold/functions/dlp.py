"""Payment cards, identity numbers and bank numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .raw import byte_text, col, match_offsets

#: First six digits from, to; number of digits from, to; credit card. In ascending order, ranges don't overlap.
ISSUERS = tuple(
    tuple(int(x) for x in row.split("-"))
    for row in (
        "100000-199999-13-15-0 222100-272099-16-16-1 300000-305999-14-16-1 309500-309599-14-16-1 340000-349999-15-15-1 352800-358999-16-16-1 "
        "360000-369999-14-16-1 370000-379999-15-15-1 380000-399999-16-16-1 400000-499999-16-16-1 500000-509999-16-16-0 510000-559999-16-16-1 "
        "601100-601199-16-16-1 622126-622926-16-16-1 624000-626999-16-16-1 628200-628899-16-16-1 644000-659999-16-16-1"
    ).split()
)
BANKS = tuple(int(x) for part in ("1-4", "6", "10", "16", "30", "39", "117", "127", "177", "219", "260", "290", "308-309", "326", "338", "340", "509", "540", "614", "809", "815", "819", "828-829", "837", "839", "865", "879", "889", "899-900") for a, _, b in [part.partition("-")] for x in range(int(a), int(b or a) + 1))
#: A digit after none, from which a card number may go on, and the longest head of what follows that can be one.
CARD = r"(?<![0-9])[0-6](?:[ -]{0,8}[0-9]){12}"
HEAD = r"\A[0-9](?:[ -]{0,8}[0-9]){0,%d}"
#: Up to eight breaks; the ninth ends a number.
BROKEN = r"\A[0-9](?:(?:[0-9]*[ -]){0,8}[0-9]+)?"
#: After a card number the next one may start this many bytes past its start.
APART = 16
SSN = r"(?<![0-9])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])"
STRIPPED = r"(?<![0-9])([0-9]{9})(?![0-9])"


def luhn(digits: Column | str) -> Column:
    return F.luhn_check(col(digits)) if hasattr(F, "luhn_check") else F.call_function("luhn_check", col(digits))


def issuer(digits: Column | str, credit_only: bool = False) -> Column:
    """(least, most) number of digits of the issuer's range that holds the first six digits; null without one."""
    six = F.substring(col(digits), 1, 6).cast("int")
    found = None
    for lo, hi, least, most, credit in ISSUERS:
        if credit or not credit_only:
            row = F.struct(F.lit(least).alias("least"), F.lit(most).alias("most"))
            found = F.when(six.between(lo, hi), row) if found is None else found.when(six.between(lo, hi), row)
    return found


def _read(candidates: Column, credit_only: bool) -> Column:
    """Of structs of place and bytes those at whose start a card number stands, with its digits, read up to its issuer's greatest length.

    Each step is a transform, so that no expression stands twice in a later one.
    """
    plain = lambda c: F.regexp_replace(c, "[ -]", "")
    cut = lambda c, most: F.regexp_extract(c, HEAD % (most - 1), 0)
    x = F.transform(candidates, lambda h: F.struct(h["at"].alias("at"), h["c"].alias("c"), plain(cut(h["c"], 6)).alias("six")))
    x = F.transform(x, lambda h: F.struct(h["at"].alias("at"), h["c"].alias("c"), issuer(h["six"], credit_only).alias("own")))
    x = F.filter(x, lambda h: h["own"].isNotNull())
    mosts = sorted({row[3] for row in ISSUERS})

    def run(h: Column) -> Column:
        longest = cut(h["c"], mosts[-1])
        for most in mosts[:-1]:
            longest = F.when(h["own"]["most"] == most, cut(h["c"], most)).otherwise(longest)
        return F.regexp_extract(longest, BROKEN, 0)

    x = F.transform(x, lambda h: F.struct(h["at"].alias("at"), h["c"].alias("c"), h["own"]["least"].alias("least"), run(h).alias("run")))
    x = F.transform(x, lambda h: F.struct(h["at"].alias("at"), h["least"].alias("least"), plain(h["run"]).alias("digits"), h["c"].substr(F.length(h["run"]) + 1, F.lit(1)).alias("next")))
    return F.filter(x, lambda h: (F.length(h["digits"]) >= h["least"]) & ~h["next"].rlike("[0-9]") & luhn(h["digits"]))


def valid_card(candidate: Column | str, credit_only: bool = False) -> Column:
    """Does a card number, with up to eight breaks of blank or hyphen, start here? The longest head that the issuer admits is tested."""
    c = F.coalesce(col(candidate), F.lit(""))
    return F.size(_read(F.array(F.struct(F.lit(0).cast("long").alias("at"), c.alias("c"))), credit_only)) > 0


def cards(content: Column | str, credit_only: bool = False) -> Column:
    """All card numbers of a text, digits only: looked for at every digit that follows none."""
    text = byte_text(content)
    starts = F.regexp_extract_all(text, F.lit(f"(?={CARD})(?=([0-9 -]{{1,27}}))"), F.lit(1))
    found = F.zip_with(match_offsets(text, CARD), starts, lambda at, c: F.struct(at.alias("at"), c.alias("c")))
    return _apart(_read(found, credit_only))


def _apart(hits: Column) -> Column:
    none = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<string>").alias("found"))
    add = lambda acc, h: F.when(h["at"] < acc["next"], acc).otherwise(F.struct((h["at"] + APART).alias("next"), F.concat(acc["found"], F.array(h["digits"])).alias("found")))
    return F.aggregate(hits, none, add, lambda acc: acc["found"])


def valid_ssn(number: Column | str) -> Column:
    """Area 1 to 772 but for 666, group and serial not zero; hyphens are passed over."""
    d = F.regexp_replace(col(number), "-", "")
    area, group, serial = (F.substring(d, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    return area.between(1, 772) & (area != 666) & (group > 0) & (serial > 0)


def ssns(content: Column | str, hyphens: bool = True, stripped: bool = False) -> Column:
    """All identity numbers, in one or both notations."""
    found = []
    for wanted, pattern in ((hyphens, SSN), (stripped, STRIPPED)):
        if wanted:
            found.append(F.filter(F.regexp_extract_all(byte_text(content), F.lit(pattern), F.lit(1)), valid_ssn))
    return F.concat(*found) if found else F.array().cast("array<string>")


def valid_transit(number: Column | str) -> Column:
    """Canadian cheque transit number: five digits, a hyphen, a bank's three digits."""
    return col(number).rlike(r"\A[0-9]{5}-[0-9]{3}") & F.substring(col(number), 7, 3).try_cast("int").isin(*BANKS)


def valid_transfer(number: Column | str) -> Column:
    """Canadian transfer number: 0, a bank's three digits, a branch's five."""
    return col(number).rlike(r"\A0[0-9]{8}") & F.substring(col(number), 2, 3).try_cast("int").isin(*BANKS)


def valid_micr(number: Column | str) -> Column:
    """US routing number: weights 7, 3 and 9 give the check digit."""
    d = lambda k: F.substring(col(number), k + 1, 1).cast("int")
    total = sum((w * d(k) for k, w in enumerate((7, 3, 9, 7, 3, 9, 7, 3))), F.lit(0))
    return F.when(col(number).rlike(r"\A[0-9]{9}"), total % 10 == d(8)).otherwise(False)


def alerts(content: Column | str, min_cards: int = 3, min_ssns: int = 3, credit_only: bool = False, hyphens: bool = True, stripped: bool = False) -> Column:
    """Names of the structured-data alerts of a text."""
    return F.filter(
        F.array(
            F.when(F.size(cards(content, credit_only)) >= min_cards, "Heuristics.Structured.CreditCardNumber"),
            F.when(F.size(ssns(content, hyphens, stripped)) >= min_ssns, "Heuristics.Structured.SSN"),
        ),
        lambda a: a.isNotNull(),
    )
