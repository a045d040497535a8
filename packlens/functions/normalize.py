"""Value normalisers: raw captured text -> typed struct (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V
from packlens.functions.text import (
    SPACE, blank_to_null, ci, count_of, found, group, let, lookup, one_of, strip, strip_set,
    title_case, words,
)


def _number(text: Column) -> Column:
    return text.try_cast("double")


# ------------------------------------------------------------------- predicates (SC12)
# One scan for both lexicons. The look-ahead names the first two letters of their words, which
# skips nearly every word start before the long alternations are tried.
_NUTRITION = (
    r"(?=[NSPAECTFRDMVI][UEPNRADOHI])\b(?:" + V.NUTRITION_HEADER + "|" + V.NUTRITION_KEYWORD + ")"
)


def is_nutrition(text: Column) -> Column:
    return found(text, _NUTRITION)


def is_instruction(text: Column) -> Column:
    return found(text, V.INSTRUCTION_REFERENCE)


def is_weight_context(text: Column) -> Column:
    return found(text, V.WEIGHT_MEASURE)


def is_licence(text: Column) -> Column:
    return found(text, V.LICENCE_OR_ID)


def has_licence_number(text: Column) -> Column:
    """EXT16: 14-digit food licence number."""
    return text.rlike("(?Ud)" + V.FSSAI_NUMBER)


def has_address_indicator(text: Column) -> Column:
    upper = F.upper(text)
    return text.rlike("(?Ud)" + V.PINCODE) | F.exists(one_of(V.ADDRESS_INDICATORS), lambda a: F.contains(upper, a))


# ----------------------------------------------------------------------- price (SC1)
def norm_amount(raw: Column, taxes: Column | None = None) -> Column:
    """Price text -> amount; a single trailing ``,dd`` is a decimal comma, other commas group digits."""
    return let(F.struct(raw.alias("raw"), (F.lit(None).cast("boolean") if taxes is None else taxes).alias("taxes")),
               lambda r: _amount(r["raw"], r["taxes"]))


def _amount(raw: Column, incl: Column) -> Column:
    text = strip(raw)
    decimal_comma = text.rlike(r",(\d{2})(?:\D|$)") & (count_of(text, ",") == 1)
    clean = (
        F.when(~F.contains(text, F.lit(",")), text)
        .when(F.contains(text, F.lit(".")), F.replace(text, F.lit(","), F.lit("")))
        .when(decimal_comma, F.replace(text, F.lit(","), F.lit(".")))
        .otherwise(F.replace(text, F.lit(","), F.lit("")))
    )
    amount = _number(F.nullif(F.regexp_extract(clean, r"([0-9]+(?:\.[0-9]{1,2})?)", 1), F.lit("")))
    good = amount.isNotNull() & (amount > 0) & (amount <= V.MAX_PRICE)
    return F.struct(
        F.when(good, F.round(amount, 2)).alias("amount"),
        F.lit("INR").alias("currency"),
        F.when(good, F.coalesce(incl, F.lit(True))).otherwise(incl).alias("taxes_inclusive"),
        F.when(good, text).otherwise(raw).alias("raw_amount"),
        F.coalesce(good, F.lit(False)).alias("valid"),
    )


# -------------------------------------------------------------------- quantity (SC2, SC3)
def unit_of(raw_unit: Column) -> Column:
    clean = F.lower(strip(raw_unit))
    return F.coalesce(lookup(V.UNIT_ALIASES, clean), clean)


_MULTIPACK = "struct<units:int,unit_value:double,unit_unit:string,raw_expression:string>"


def norm_quantity(raw_value: Column, raw_unit: Column) -> Column:
    """Value and unit -> SI canonical value; count units stay as they are."""
    inputs = F.struct(
        _number(F.replace(strip(raw_value), F.lit(","), F.lit("."))).alias("value"),
        F.when(F.length(raw_unit) > 0, unit_of(raw_unit)).alias("unit"), strip(raw_unit).alias("raw_unit"))

    def build(q: Column) -> Column:
        value, unit = q["value"], q["unit"]
        canonical = (
            F.when(unit == "kg", F.round(value * 1000, 4))
            .when(unit == "mg", F.round(value / 1000, 6))
            .when(unit == "L", F.round(value * 1000, 4))
            .when(unit.isin("g", "ml", "pcs", "units", *V.COUNT_UNITS), value)
        )
        canonical_unit = F.when(value.isNotNull(), (
            F.when(unit.isin("kg", "mg", "g"), "g")
            .when(unit.isin("L", "ml"), "ml")
            .when(unit.isin("pcs", "units"), "units")
            .when(unit.isin(*V.COUNT_UNITS), unit)
        ))
        return F.struct(
            value.alias("value"), unit.alias("unit"), q["raw_unit"].alias("raw_unit"),
            canonical.alias("canonical_value"), canonical_unit.alias("canonical_unit"),
            F.lit(False).alias("is_multipack"), F.lit(None).cast(_MULTIPACK).alias("multipack"),
            F.coalesce(value > 0, F.lit(False)).alias("valid"),
        )

    return let(inputs, build)


def norm_multipack(text: Column) -> Column:
    """``10 N x 82.7 g = 827 g`` -> total and per-unit quantities."""

    def build(clean: Column) -> Column:
        raw_u1 = F.coalesce(group(clean, V.QTY_MULTIPACK, 3), F.lit("g"))
        raw_u2 = F.coalesce(group(clean, V.QTY_MULTIPACK, 5), raw_u1)
        u1 = unit_of(raw_u1)
        u2 = F.coalesce(lookup(V.UNIT_ALIASES, F.lower(raw_u2)), u1)
        total = _number(group(clean, V.QTY_MULTIPACK, 4))
        large = u2.isin("kg", "L")
        return F.struct(
            total.alias("value"), u2.alias("unit"), raw_u2.alias("raw_unit"),
            F.when(large, F.round(total * 1000, 4)).otherwise(total).alias("canonical_value"),
            F.when(u2 == "kg", "g").when(u2 == "L", "ml").otherwise(u2).alias("canonical_unit"),
            F.lit(True).alias("is_multipack"),
            F.struct(
                group(clean, V.QTY_MULTIPACK, 1).try_cast("int").alias("units"),
                _number(group(clean, V.QTY_MULTIPACK, 2)).alias("unit_value"),
                u1.alias("unit_unit"), strip(text).alias("raw_expression"),
            ).alias("multipack"),
            F.lit(True).alias("valid"),
        )

    return let(F.replace(strip(text), F.lit(","), F.lit(".")), build)


# ----------------------------------------------------------------------- dates (SC4)
def norm_date(text: Column, label: Column) -> Column:
    """First readable date; relative forms first, then from the most to the least specific.

    Values stay ISO strings plus parts: months may have 31 days here, so a DATE would reject them.
    """
    null_int, null_str = F.lit(None).cast("int"), F.lit(None).cast("string")

    def captures(t: Column) -> Column:
        def part(pattern: str, i: int) -> Column:
            return group(t, pattern, i).try_cast("int")

        def month_name(pattern: str, i: int) -> Column:
            return lookup(V.MONTHS, F.upper(group(t, pattern, i)))

        def triple(name: str, day: Column, month: Column, year: Column) -> Column:
            return F.struct(day.alias("d"), month.alias("m"), year.alias("y")).alias(name)

        return F.struct(
            t.alias("text"),
            part(V.RELATIVE_DATE, 1).alias("n"), F.upper(group(t, V.RELATIVE_DATE, 2)).alias("n_unit"),
            triple("dmy", part(V.DATE_DMY, 1), part(V.DATE_DMY, 2), part(V.DATE_DMY, 3)),
            triple("dby", part(V.DATE_DAY_MONTH_YEAR, 1), month_name(V.DATE_DAY_MONTH_YEAR, 2), part(V.DATE_DAY_MONTH_YEAR, 3)),
            triple("by", null_int, month_name(V.DATE_MONTH_YEAR, 1), part(V.DATE_MONTH_YEAR, 2)),
            triple("my", null_int, part(V.DATE_MY, 1), part(V.DATE_MY, 2)),
            triple("my2", null_int, part(V.DATE_MY_SHORT, 1), part(V.DATE_MY_SHORT, 2)),
        )

    def choose(c: Column) -> Column:
        def fixed(fmt: str, p: Column) -> Column:
            return F.struct(F.lit(fmt).alias("format"), p["d"].alias("d"), p["m"].alias("m"),
                            F.when(p["y"] < 100, p["y"] + 2000).otherwise(p["y"]).alias("y"))

        picked = (
            F.when(c["n"].isNotNull(), F.struct(null_str.alias("format"), null_int.alias("d"), null_int.alias("m"), null_int.alias("y")))
            .when(c["dmy"]["m"].between(1, 12) & c["dmy"]["d"].between(1, 31), fixed("DD/MM/YYYY", c["dmy"]))
            .when(c["dby"]["m"].isNotNull() & c["dby"]["d"].between(1, 31), fixed("DD-MMM-YYYY", c["dby"]))
            .when(c["by"]["m"].isNotNull(), fixed("MMM YYYY", c["by"]))
            .when(c["my"]["m"].between(1, 12), fixed("MM/YYYY", c["my"]))
            .when(c["my2"]["m"].between(1, 12), fixed("MM/YY", c["my2"]))
        )

        def build(p: Column) -> Column:
            relative = c["n"].isNotNull()
            return F.when(p.isNotNull(), F.struct(
                F.when(p["d"].isNotNull(), F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"]))
                .when(p["y"].isNotNull(), F.format_string("%04d-%02d", p["y"], p["m"])).alias("date"),
                p["d"].alias("day"), p["m"].alias("month"), p["y"].alias("year"), p["format"].alias("format"),
                label.alias("semantic_type"), relative.alias("is_relative"), c["n"].alias("relative_duration"),
                F.when(relative, c["n_unit"]).alias("relative_unit"), F.when(relative, c["text"]).alias("relative_text"),
                F.lit(True).alias("valid"),
            ))

        return let(picked, build)

    return let(let(strip(text), captures), choose)


# --------------------------------------------------------------------- country (SC5, JN11)
def norm_country(raw: Column) -> Column:
    clean = strip(F.split(strip_set(strip(raw), ".:-"), r"(?U)\s{2,}|\n|\r")[0])
    upper = F.upper(strip(F.regexp_replace(clean, r"(?U)[^a-zA-Z\s]", "")))
    exact = lookup(V.COUNTRY_ALIASES, upper)
    contained = let(upper, lambda u: F.get(F.filter(one_of(V.COUNTRY_ALIASES), lambda a: F.contains(u, a)), F.lit(0)))
    country = F.coalesce(exact, lookup(V.COUNTRY_ALIASES, contained))
    return F.struct(
        F.coalesce(country, title_case(clean)).alias("country"), clean.alias("raw"),
        country.isNotNull().alias("is_recognized"),
        (country.isNotNull() | (F.length(upper) >= 2)).alias("valid"),
    )


# ------------------------------------------------------------- phone, e-mail (SC6, SC7)
def norm_phone(raw: Column) -> Column:
    """Indian phone numbers: toll-free, mobile, landline; 14 digits are a food licence."""
    parts = let(strip_set(strip(raw), ".:-"), lambda c: F.struct(
        c.alias("clean"), F.regexp_replace(c, r"(?U)[^\d]", "").alias("digits"), strip(raw).alias("raw")))
    return let(parts, lambda p: _phone(p["clean"], p["digits"], p["raw"]))


def _phone(clean: Column, digits: Column, raw: Column) -> Column:
    n = F.length(digits)
    toll_free = digits.startswith("1800")
    local = F.when(digits.startswith("91") & (n == 12), F.substring(digits, 3, 10)).otherwise(digits)
    m = F.length(local)
    good = (
        (toll_free & n.between(10, 11))
        | ((m == 10) & F.left(local, F.lit(1)).isin("6", "7", "8", "9"))
        | m.isin(7, 8, 11)
        | (n.between(8, 11) & digits.startswith("0"))
    ) & (n != 14)
    number = (
        F.when(toll_free & (n == 10), F.concat(F.lit("1800-"), F.substring(digits, 5, 3), F.lit("-"), F.substring(digits, 8, 3)))
        .when(toll_free & (n == 11), F.concat(F.lit("1800-"), F.substring(digits, 5, 4), F.lit("-"), F.substring(digits, 9, 3)))
        .when(toll_free, clean)
        .when(m == 10, F.concat(F.lit("+91 "), F.substring(local, 1, 5), F.lit(" "), F.substring(local, 6, 5)))
        .otherwise(F.regexp_replace(clean, SPACE, " "))
    )
    return F.struct(
        F.when(good, number).alias("number"), digits.alias("digits"), raw.alias("raw"),
        good.alias("valid"),
        F.when(n == 14, F.lit("14-digit FSSAI licence number"))
        .when(~good, F.format_string("digit count %d is outside valid phone range", n)).alias("rejection_reason"),
    )


def norm_email(raw: Column) -> Column:
    clean = strip_set(strip(raw), ".:-")
    for pattern, repl in ((ci(r"\s*\[at\]\s*"), "@"), (r"(?U)\s*@\s*", "@"), (r"(?U)\s*\.\s*", ".")):
        clean = F.regexp_replace(clean, pattern, repl)
    email = F.lower(clean)
    return F.struct(
        email.alias("email"), strip(raw).alias("raw"), email.rlike(V.EMAIL_VALID).alias("valid")
    )


# --------------------------------------------------------------- organisation (SC8, SC9)
def split_name_address(line: Column) -> Column:
    """One-line ``name + address`` -> struct(name, address); address null when nothing splits.

    Three strategies, first hit wins: after a company suffix, before the first address word,
    before the last separator in front of the PIN code.
    """
    suffixes, indicators = one_of(V.COMPANY_SUFFIXES), one_of(V.ADDRESS_INDICATORS)

    def pair(name: Column, address: Column) -> Column:
        return F.struct(name.alias("name"), address.alias("address"))

    def first_index(tokens: Column, hit) -> Column:
        return F.array_min(F.transform(tokens, lambda t, i: F.when(hit(t, i), i)))

    def join(tokens: Column, start: Column, length: Column) -> Column:
        return F.array_join(F.slice(tokens, start, length), " ")

    def by_suffix(tokens: Column) -> Column:
        def hit(t, i):
            nxt = F.get(tokens, i + 1)
            nxt_word = F.upper(F.rtrim(nxt, F.lit(",.-")))
            boundary = t.endswith(",") | F.coalesce(
                nxt.startswith(",") | F.array_contains(indicators, nxt_word)
                | nxt_word.rlike(r"^\d+$") | F.contains(nxt, F.lit("/")), F.lit(False))
            return F.array_contains(suffixes, F.upper(F.rtrim(t, F.lit(",.-")))) & boundary

        def cut(i):
            return F.when(i.isNotNull(), pair(
                F.rtrim(join(tokens, F.lit(1), i + 1), F.lit(",- ")),
                F.ltrim(join(tokens, i + 2, F.size(tokens)), F.lit(",- "))))

        return let(first_index(tokens, hit), cut)

    def by_indicator(tokens: Column) -> Column:
        def hit(t, i):
            word = F.upper(F.btrim(t, F.lit(".,:-")))
            return (i > 0) & (F.array_contains(indicators, word) | (F.contains(t, F.lit("/")) & t.rlike(r"\d")))

        def cut(i):
            head = join(tokens, F.lit(1), i)
            last_comma = F.length(head) - F.instr(F.reverse(head), ",")
            name = strip(F.left(head, last_comma))
            at_comma = pair(name, strip(F.ltrim(F.substring(line, F.length(name) + 1, F.length(line)), F.lit(" ,.-"))))
            at_word = pair(F.btrim(head, F.lit(" ,.-")), strip(join(tokens, i + 1, F.size(tokens))))
            return F.when(i.isNotNull(), F.when(F.contains(head, F.lit(",")), at_comma).otherwise(at_word))

        return let(first_index(tokens, hit), cut)

    def by_pin() -> Column:
        pin_at = F.regexp_instr(line, F.lit("(?Ud)" + V.PINCODE))
        before = F.rtrim(F.left(line, pin_at - 1), F.lit(" ,.-"))

        def cut(head):
            rev = F.reverse(head)
            comma = F.when(F.contains(head, F.lit(",")), F.length(head) - F.instr(rev, ","))
            dash = F.when(F.contains(head, F.lit(" - ")), F.length(head) - F.instr(rev, " - ") - 2)
            sep = F.greatest(comma, dash)
            name = strip(F.left(line, sep))
            return F.when((sep > 0) & (name != ""), pair(
                name, F.btrim(F.substring(line, sep + 2, F.length(line)), F.lit(" ,"))))

        return F.when(pin_at > 0, let(before, cut))

    return let(words(line), lambda tokens: F.coalesce(
        by_suffix(tokens), by_indicator(tokens), by_pin(),
        pair(line, F.lit(None).cast("string"))))


def norm_org(raw: Column, role: Column) -> Column:
    """Organisation text -> name, address, PIN code. Several lines: the first one is the name."""

    def build(clean: Column) -> Column:
        lines = F.filter(F.transform(F.split(clean, r"\r\n|\n|\r"), strip), lambda x: x != "")

        def from_lines(ls: Column) -> Column:
            single = F.coalesce(F.get(ls, F.lit(0)), clean)
            return F.when(F.size(ls) >= 2, F.struct(
                F.get(ls, F.lit(0)).alias("name"),
                F.array_join(F.slice(ls, F.lit(2), F.size(ls)), ", ").alias("address"),
            )).otherwise(split_name_address(single))

        def finish(parts: Column) -> Column:
            name = strip_set(parts["name"], " ,-")
            return F.struct(
                name.alias("name"), F.coalesce(parts["address"], F.lit("")).alias("address"),
                F.replace(F.nullif(F.regexp_extract(clean, "(?Ud)" + V.PINCODE, 1), F.lit("")), F.lit(" "), F.lit("")).alias("pincode"),
                role.alias("role"), clean.alias("raw"),
                ((F.length(name) > 0) & (count_of(name, "[a-zA-Z]") >= 2)).alias("valid"),
            )

        return let(let(lines, from_lines), finish)

    return let(strip_set(strip(raw), ".:-"), build)


# ----------------------------------------------------------------------- batch (SC10)
def norm_batch(raw: Column) -> Column:
    """Batch code, or the reason why the text is not one."""
    stop = one_of(V.INSTRUCTION_STOP_WORDS)

    def build(clean: Column) -> Column:
        tokens = F.filter(F.transform(words(clean), lambda w: F.upper(strip_set(w, ".:-,/"))), lambda w: w != "")

        def rescue(ws: Column) -> Column:
            code = F.get(F.filter(
                F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1))),
                lambda w: ~F.array_contains(stop, w) & w.rlike(r"(?U)\d") & (F.length(w) >= 2)), F.lit(0))
            leads_with_stop = F.coalesce(F.array_contains(stop, F.get(ws, F.lit(0))), F.lit(False)) & (F.size(ws) <= 5)
            return F.struct(
                F.when(F.size(ws) == 0, F.lit(None).cast("string"))
                .when(leads_with_stop, code).otherwise(clean).alias("code"),
                (is_instruction(clean) | (leads_with_stop & code.isNull())).alias("instruction"),
            )

        def finish(r: Column) -> Column:
            code = r["code"]
            no_digit = count_of(code, r"(?U)\d") < 1
            too_long = (F.length(code) > 25) & F.contains(code, F.lit(" "))
            enough = count_of(code, "[a-zA-Z0-9]") >= 2
            return F.struct(
                F.when(~r["instruction"] & enough & ~no_digit & ~too_long, code).alias("batch_number"),
                strip(raw).alias("raw"),
                r["instruction"].alias("is_instruction_only"),
                F.when(~r["instruction"] & enough, (
                    F.when(no_digit, F.lit("no digits found; likely product name spillover"))
                    .when(too_long, F.lit("value too long and contains spaces; likely sentence spillover"))
                )).alias("rejection_reason"),
            )

        return F.when(clean != "", let(let(tokens, rescue), finish))

    return let(strip_set(strip(raw), ".:- #"), build)


def batch_value(raw: Column) -> Column:
    """Accepted batch code of a text, null when another kind of text was captured."""
    other = (
        is_nutrition(raw) | is_weight_context(raw) | is_licence(raw)
        | found(raw, V.QTY_MULTIPACK) | has_address_indicator(raw)
    )
    return F.when(~other, norm_batch(raw)["batch_number"])


# ------------------------------------------------------------------- commodity (SC11)
def norm_commodity(raw: Column) -> Column:
    clean = strip_set(strip(F.split(strip(raw), r"[\n\r]")[0]), ".:- #()[]{}\"'")

    def build(c: Column) -> Column:
        prefix = F.get(F.filter(one_of(V.COMMODITY_EXCLUDED_PREFIXES), lambda p: F.upper(c).startswith(p)), F.lit(0))
        few = count_of(c, "[a-zA-Z]") < 3
        context = is_nutrition(c) | is_instruction(c)
        too_long = F.length(c) > 60
        good = ~few & ~context & prefix.isNull() & ~too_long
        return F.struct(
            F.when(good, title_case(c)).alias("commodity_name"), strip(raw).alias("raw"), good.alias("valid"),
            F.when(~few & ~context & prefix.isNotNull(), F.concat(F.lit("starts with excluded prefix: "), prefix))
            .when(~few & ~context & too_long, F.lit("value too long; likely OCR merge artefact")).alias("rejection_reason"),
        )

    return let(clean, build)


# ------------------------------------------------------------------- signature (SC15)
def signature(dtype: Column, n: Column) -> Column:
    """Deduplication key: two candidates of a type with one key state the same fact."""

    def num(*choices: Column) -> Column:
        return F.format_string("%.6f", F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in choices]))

    name = F.upper(strip(n["name"]))
    address = F.upper(strip(n["address"]))
    return (
        F.when(dtype == "MRP", F.concat(F.lit("MRP_"), num(n["amount"])))
        .when(dtype == "NET_QUANTITY", F.concat_ws("_", F.lit("NETQTY"), num(n["canonical_value"], n["value"]),
                                                   F.coalesce(n["canonical_unit"], n["unit"], F.lit("None"))))
        .when(dtype.isin(V.DATE_TYPES), F.concat(F.lit("DATE_"), F.coalesce(n["date"], n["relative_text"])))
        .when(dtype == "COUNTRY_OF_ORIGIN", F.concat(F.lit("COUNTRY_"), n["country"]))
        .when(dtype == "CONSUMER_CARE_PHONE", F.concat(F.lit("PHONE_"), F.coalesce(n["digits"], n["number"])))
        .when(dtype == "CONSUMER_CARE_EMAIL", F.concat(F.lit("EMAIL_"), F.lower(n["email"])))
        .when(dtype == "BATCH_OR_LOT_NUMBER", F.concat(F.lit("BATCH_"), F.upper(n["batch_number"])))
        .when(dtype == "COMMODITY_NAME", F.concat(F.lit("COMMODITY_"), F.upper(n["commodity_name"])))
        .when(dtype.isin("MANUFACTURER_NAME", "PACKER_NAME", "IMPORTER_NAME"),
              F.concat(F.lit("ORG_"), F.left(name, F.lit(40))))
        .when(dtype.isin("MANUFACTURER_ADDRESS", "PACKER_ADDRESS", "IMPORTER_ADDRESS"),
              F.coalesce(F.concat(F.lit("ADDR_PIN_"), n["pincode"]), F.concat(F.lit("ADDR_"), F.left(address, F.lit(50)))))
        .otherwise(F.to_json(n))
    )


def fill_missing(existing: Column, incoming: Column) -> Column:
    """PRJ3: keep the stored value unless it is blank."""
    return F.coalesce(blank_to_null(existing), blank_to_null(incoming))
