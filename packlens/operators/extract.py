"""Extraction operators: spans -> typed declaration candidates.

Two narrow passes over the spans, without a further shuffle. The first scans every span once and emits
one *hit* per anchor found (most spans emit none, and cheap substring guards keep them away from the
regular expressions). The second pass normalises and scores hits only. Date and batch anchors without a
value of their own look for one among the value blocks of their strip, which travel with the spans.

Filters sit after a generator on purpose: a filter above a projection is pushed below it together with
the projection's expressions, and the wide value expressions would then run twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V
from packlens.functions import normalize as N
from packlens.functions import scores as S
from packlens.functions.text import ci, found, group, let, strip
from packlens.operators.layout import STRIP_PX, ocr_confidence, span_rows, with_blocks

FAMILIES = ("mrp", "quantity", "country", "dates", "organisations", "care", "batch", "commodity")
_DATE_EXT = {t: 3 + i for i, t in enumerate(V.DATE_TYPES)}
_ORG_EXT = {role: 8 + 2 * i for i, role in enumerate(V.ORG_PREFIXES)}
_EXT = {"MRP": 0, "NET_QUANTITY": 1, "COUNTRY_OF_ORIGIN": 2, "CONSUMER_CARE_PHONE": 16,
        "CONSUMER_CARE_EMAIL": 17, "CONSUMER_CARE_ADDRESS": 18, "BATCH_OR_LOT_NUMBER": 19, "COMMODITY_NAME": 20}


def _hit(kind: str, ext: int, raw: Column, how: str | Column, unit: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(ext).alias("ext"), raw.alias("raw"),
        (F.lit(how) if isinstance(how, str) else how).alias("how"),
        (F.lit(None).cast("string") if unit is None else unit).alias("unit"),
    )


def _any(upper: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(upper, F.lit(p))
    return out


def _guarded(guard: Column, found_hit: Column) -> Column:
    """Evaluate ``found_hit`` only where the cheap guard holds.

    A nested conditional, not ``guard & ...``: both sides of an AND take part in common-subexpression
    elimination and would be computed for every span.
    """
    return F.when(guard, found_hit)


def _has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


# --------------------------------------------------------------- anchors (first pass)
_PRICE_GUARD, _CURRENCY_GUARD = ("PRICE", "MRP", "M.R", "MR.P"), ("₹", "RS", "INR")
_MULTIPACK_GUARD, _QTY_GUARD = ("=", "EQUAL", "("), ("NET", "NW", "N.W", "NV", "N.V")
_COUNTRY_GUARD = ("ORIGIN", "MADE", "PRODUCT", "MANUFACTURED")
_SHELF_LIFE_GUARD = ("FROM", "OF")
_CARE_GUARD = ("CONSUMER", "CUSTOMER", "FOR", "CONTACT", "CARE", "HELPLINE")
_BATCH_GUARD, _COMMODITY_GUARD = ("BATCH", "LOT", "NO", "BN"), ("NAME", "COMMODITY")


def price_hit(text: Column, n_blocks: Column, upper: Column) -> Column:
    """EXT1, EXT2: labelled price, else a bare currency amount in a span of at most two blocks."""
    labelled = group(text, V.MRP_EXPLICIT)
    bare = group(text, V.MRP_CURRENCY_ONLY)
    around = F.regexp_extract(text, "(?Uids)(.{0,5}" + V.MRP_CURRENCY_ONLY + ".{0,5})", 1)
    date_near = (F.contains(text, F.lit("/")) | F.contains(text, F.lit("-"))) & around.rlike("(?Ud)" + V.DATE_LIKE)
    weight = N.is_weight_context(text) | found(text, V.SMALL_WEIGHT)
    guard = _has_digit(text)
    return F.coalesce(
        _guarded(guard & _any(upper, *_PRICE_GUARD),
                 F.when(labelled.isNotNull(), _hit("MRP", 0, labelled, "labelled"))),
        _guarded(guard & (n_blocks <= 2) & _any(upper, *_CURRENCY_GUARD),
                 F.when(bare.isNotNull() & ~weight & ~date_near, _hit("MRP", 0, bare, "currency"))),
    )


def quantity_hit(text: Column, n_blocks: Column, upper: Column) -> Column:
    """EXT3 to EXT6, first match wins: multipack, labelled, counted, stand-alone."""
    labelled = group(text, V.QTY_EXPLICIT)
    counted = group(text, V.QTY_COUNT)
    alone, alone_unit = group(text, V.QTY_STANDALONE), group(text, V.QTY_STANDALONE, 2)
    return _guarded(_has_digit(text), F.coalesce(
        _guarded(_any(upper, *_MULTIPACK_GUARD),
                 F.when(found(text, V.QTY_MULTIPACK), _hit("NET_QUANTITY", 1, text, "multipack"))),
        _guarded(_any(upper, *_QTY_GUARD),
                 F.when(labelled.isNotNull(), _hit("NET_QUANTITY", 1, labelled, "labelled", group(text, V.QTY_EXPLICIT, 2)))),
        _guarded(n_blocks <= 2,
                 F.when(counted.isNotNull(), _hit("NET_QUANTITY", 1, counted, "counted", group(text, V.QTY_COUNT, 2)))),
        _guarded(n_blocks <= 2,
                 F.when(alone.isNotNull() & (F.lower(alone_unit) != "mg"), _hit("NET_QUANTITY", 1, alone, "alone", alone_unit))),
    ))


def country_hit(text: Column, n_blocks: Column, upper: Column) -> Column:
    """EXT7."""
    raw = group(text, V.COUNTRY_ORIGIN)
    guard = _any(upper, *_COUNTRY_GUARD)
    return _guarded(guard, F.when(raw.isNotNull(), _hit("COUNTRY_OF_ORIGIN", 2, raw, "labelled")))


_DATE_GUARD = {
    "DATE_OF_MANUFACTURE": ("MFD", "MFG", "MANUFACTURED"), "DATE_OF_PACKING": ("PKD", "PACK"),
    "DATE_OF_IMPORT": ("IMP",), "BEST_BEFORE": ("BEFORE", "BB", "B.B"), "EXPIRY_DATE": ("EXP", "USE"),
}


def date_hit(dtype: str, text: Column, upper: Column) -> Column:
    """EXT8: anchor with up to 40 following characters; relative shelf life counts as best-before."""
    pattern = V.DATE_ANCHORS[dtype]
    anchored = _guarded(_any(upper, *_DATE_GUARD[dtype]), F.when(
        found(text, pattern), _hit(dtype, _DATE_EXT[dtype], F.regexp_extract(text, ci(pattern), 1), "date")))
    if dtype != "BEST_BEFORE":
        return anchored
    number = group(text, V.RELATIVE_DATE)
    return F.coalesce(anchored, _guarded(
        _has_digit(text) & _any(upper, *_SHELF_LIFE_GUARD), F.when(number.isNotNull(), _hit(dtype, _DATE_EXT[dtype], number, "date"))))


_ORG_GUARD = {"MANUFACTURER": ("BY", "MANUFACTURED"), "PACKER": ("BY",), "IMPORTER": ("BY", "IMPORTER"),
              "MARKETER": ("BY",)}


def org_hit(role: str, text: Column, upper: Column) -> Column:
    """EXT9: text after the role prefix, up to the first blank line."""
    prefix = V.ORG_PREFIXES[role]
    content = strip(F.regexp_replace(text, "(?Uid)^" + prefix, ""))
    section = strip(F.split(content, r"\n{2,}")[0])
    return _guarded(_any(upper, *_ORG_GUARD[role]), F.when(
        found(text, prefix), F.when(content != "", _hit(role, _ORG_EXT[role], section, "org"))))


def _maybe_phone(text: Column) -> Column:
    """Cheap necessary condition of the phone pattern."""
    return text.rlike(r"(?U)1[\s-]?800|[6-9][0-9]{4}|0[0-9]{2}")


def _maybe_email(text: Column) -> Column:
    return F.contains(text, F.lit("@")) | text.rlike(r"(?i)\[at\]")


def _maybe_date(text: Column) -> Column:
    return text.rlike(r"(?Ui)[0-9][/.-][0-9]|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC|MONTH|DAY|WEEK|YEAR")


def phone_hit(text: Column, n_blocks: Column, upper: Column) -> Column:
    """EXT10."""
    raw = group(text, V.PHONE, 0)
    contact = found(text, V.CARE_HEADER) | found(text, V.CONTACT_PREFIX)
    toll_free = F.contains(raw, F.lit("1800")) | F.contains(raw, F.lit("1-800"))
    return _guarded(_maybe_phone(text), F.when(
        raw.isNotNull() & (toll_free | contact) & ~N.is_licence(text) & ~N.has_licence_number(text),
        _hit("CONSUMER_CARE_PHONE", 16, raw, "labelled")))


def email_hit(text: Column, n_blocks: Column, upper: Column) -> Column:
    """EXT11."""
    raw = group(text, V.EMAIL)
    labelled = F.contains(text, F.lit("@")) | found(text, V.CARE_HEADER)
    return _guarded(_maybe_email(text), F.when(
        raw.isNotNull(), _hit("CONSUMER_CARE_EMAIL", 17, raw, F.when(labelled, "labelled").otherwise("plain"))))


def care_address_hit(text: Column, is_multi: Column, upper: Column) -> Column:
    """EXT12: several lines under a care header without phone or e-mail."""
    guard = _any(upper, *_CARE_GUARD)
    phone = _guarded(_maybe_phone(text), found(text, V.PHONE))
    email = _guarded(_maybe_email(text), found(text, V.EMAIL))
    return _guarded(is_multi & guard, F.when(found(text, V.CARE_HEADER), F.when(
        ~F.coalesce(phone, F.lit(False)) & ~F.coalesce(email, F.lit(False)), _hit("CONSUMER_CARE_ADDRESS", 18, text, "care"))))


def batch_hit(text: Column, n_blocks: Column, upper: Column) -> Column:
    """EXT13."""
    raw = group(text, V.BATCH, multiline=True)
    return _guarded(_any(upper, *_BATCH_GUARD),
                    F.when(raw.isNotNull(), _hit("BATCH_OR_LOT_NUMBER", 19, raw, "batch")))


def commodity_hit(text: Column, n_blocks: Column, upper: Column) -> Column:
    """EXT14."""
    raw = group(text, V.COMMODITY)
    return _guarded(_any(upper, *_COMMODITY_GUARD),
                    F.when(raw.isNotNull(), _hit("COMMODITY_NAME", 20, raw, "labelled")))


def unit_sale_price(text: Column) -> Column:
    """EXT15: amount per unit."""
    return F.struct(
        N.norm_amount(group(text, V.UNIT_SALE_PRICE))["amount"].alias("amount"),
        N.unit_of(group(text, V.UNIT_SALE_PRICE, 2)).alias("unit"),
    )


def find_hits(spans: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """First pass: one row per (span, anchor)."""
    text, n, upper = F.col("text"), F.col("n_blocks"), F.col("__upper")
    build = {
        "mrp": lambda: [price_hit(text, n, upper)],
        "quantity": lambda: [quantity_hit(text, n, upper)],
        "country": lambda: [country_hit(text, n, upper)],
        "dates": lambda: [date_hit(t, text, upper) for t in V.DATE_TYPES],
        "organisations": lambda: [org_hit(r, text, upper) for r in V.ORG_PREFIXES],
        "care": lambda: [phone_hit(text, n, upper), email_hit(text, n, upper),
                         care_address_hit(text, F.col("is_multi_line"), upper)],
        "batch": lambda: [batch_hit(text, n, upper)],
        "commodity": lambda: [commodity_hit(text, n, upper)],
    }
    hits = [h for f in families for h in build[f]()]
    out = (
        # the Kelvin sign is the one non-ASCII letter upper() leaves alone that matches a keyword letter
        spans.withColumn("__upper", F.replace(F.upper("text"), F.lit("\u212a"), F.lit("K")))
        .select(*spans.columns, F.explode_outer(F.array(*hits)).alias("__hit"))
        .where("__hit is not null")
        .select(*spans.columns, "__hit.*")
    )
    if "blocks" not in spans.columns:
        out = with_blocks(out)
    if not {"mrp", "quantity"} & set(families):
        return out
    # prices and quantities are not read from nutrition tables
    nutrition = F.exists("blocks", lambda b: b["nutrition"]) | ((F.col("n_blocks") > 1) & N.is_nutrition(F.col("text")))
    return out.where(~F.col("kind").isin("MRP", "NET_QUANTITY") | ~nutrition)


# ------------------------------------------------------ values and scores (second pass)
NORMALIZED = (
    "amount double, currency string, taxes_inclusive boolean, raw_amount string, value double, unit string, "
    "raw_unit string, canonical_value double, canonical_unit string, is_multipack boolean, "
    "multipack struct<units:int,unit_value:double,unit_unit:string,raw_expression:string>, "
    "date string, day int, month int, year int, format string, semantic_type string, is_relative boolean, "
    "relative_duration int, relative_unit string, relative_text string, country string, is_recognized boolean, "
    "number string, digits string, email string, name string, address string, pincode string, role string, "
    "batch_number string, commodity_name string, raw string, valid boolean"
)
_FIELDS = [tuple(part.strip().split(" ", 1)) for part in NORMALIZED.replace(
    "struct<units:int,unit_value:double,unit_unit:string,raw_expression:string>", "@").split(",")]


def _superset(**values: Column) -> Column:
    """The one nullable struct shared by all declaration types."""
    pack = "struct<units:int,unit_value:double,unit_unit:string,raw_expression:string>"
    return F.struct(*[
        values.get(name, F.lit(None)).cast(dt.replace("@", pack)).alias(name) for name, dt in _FIELDS
    ])


# ------------------------------------------------------------- values of nearby blocks
_NEAR_GUARD = r"(?Ui)M(?:FD|FG|ANUFACTURED)|P(?:KD|ACK)|IMP|BEFORE|B\.?B|EXP|USE|MONTH|DAY|WEEK|YEAR|BATCH|LOT|NO|BN"
_NEAR = (
    "struct<x1:int,y1:int,block_order:bigint,block_id:{id},x2:int,y2:int,text:string,confidence:double,"
    "date:struct<date:string,day:int,month:int,year:int,format:string,semantic_type:string,is_relative:boolean,"
    "relative_duration:int,relative_unit:string,relative_text:string,valid:boolean>,batch:string>"
)


def near_value(id_type: str) -> Column:
    """A block that can be the value of a nearby date or batch anchor, else null.

    Blocks that are anchors themselves are no values, so nobody's value is stolen.
    """
    text = F.col("text")

    def is_any(*patterns: str) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | found(text, p)
        return out

    mfd, pkd, bb, exp = (V.DATE_ANCHORS[t] for t in ("DATE_OF_MANUFACTURE", "DATE_OF_PACKING", "BEST_BEFORE", "EXPIRY_DATE"))
    date = _guarded(_maybe_date(text), F.when(~is_any(mfd, pkd, exp), N.norm_date(text, F.lit(None).cast("string"))))
    other = (
        found(text, V.BATCH, multiline=True) | N.is_nutrition(text) | (_maybe_email(text) & found(text, V.EMAIL))
        | is_any(V.LICENCE_OR_ID, V.CONTACT_PREFIX, mfd, pkd, exp, bb)
    )
    batch = F.when(~other, N.batch_value(text))
    parsed = F.when(_has_digit(text), let(F.struct(date.alias("date"), batch.alias("batch")), lambda v: v))
    block = let(parsed, lambda v: F.when(v["date"].isNotNull() | v["batch"].isNotNull(), F.struct(
        "x1", "y1", F.col("block_order").cast("bigint"), "block_id", "x2", "y2", "text", "confidence", v["date"], v["batch"])))
    return block.cast(_NEAR.format(id=id_type))


def nearest_value(blocks: Column, values: Column, field: str, max_dx: int, max_dy: int) -> Column:
    """JN7: the nearest value block around a span (smallest dx + dy, then block order)."""

    def search(box: Column) -> Column:
        def ranked(v: Column) -> Column:
            dx = S.edge_gap(box["x1"], box["x2"], v["x1"], v["x2"])
            dy = S.edge_gap(box["y1"], box["y2"], v["y1"], v["y2"])
            own = F.exists(blocks, lambda b: b["block_id"] == v["block_id"])
            return F.when(v[field].isNotNull() & (dx <= max_dx) & (dy <= max_dy) & ~own, F.struct(
                (dx + dy).alias("d"), v["block_order"].alias("o"), v["block_id"].alias("id"), v.alias("v")))

        return F.array_min(F.transform(values, ranked))["v"]

    return let(S.union_bbox(blocks), search)


def _value_columns(hits: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Normalised values of the hits; every hit fills the columns of its own kind only."""
    raw, unit, kind, how, text = (F.col(c) for c in ("raw", "unit", "kind", "how", "text"))
    cols = {
        "mrp": {"v_mrp": lambda: F.when(kind == "MRP", N.norm_amount(raw, found(text, V.INCL_TAXES)))},
        "quantity": {"v_qty": lambda: F.when(kind == "NET_QUANTITY", F.when(how == "multipack", N.norm_multipack(text))
                                             .otherwise(N.norm_quantity(raw, unit)))},
        "country": {"v_country": lambda: F.when(kind == "COUNTRY_OF_ORIGIN", N.norm_country(raw))},
        "dates": {"v_date": lambda: F.when(how == "date", N.norm_date(raw, kind))},
        "organisations": {"v_org": lambda: F.when(how == "org", N.norm_org(raw, kind))},
        "care": {"v_phone": lambda: F.when(kind == "CONSUMER_CARE_PHONE", N.norm_phone(raw)),
                 "v_email": lambda: F.when(kind == "CONSUMER_CARE_EMAIL", N.norm_email(raw))},
        "batch": {"v_batch": lambda: F.when(how == "batch", N.batch_value(raw))},
        "commodity": {"v_commodity": lambda: F.when(kind == "COMMODITY_NAME", N.norm_commodity(raw))},
    }
    return hits.withColumns({name: make() for f in families for name, make in cols[f].items()})


def _near_columns(hits: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """``near``: the value block of anchors that carry no value themselves."""
    blocks, how = F.col("blocks"), F.col("how")
    near = F.lit(None)
    if "near_values" in hits.columns:
        values = F.col("near_values")
        options = []
        if "dates" in families:
            options.append(F.when((how == "date") & F.col("v_date").isNull(),
                                  nearest_value(blocks, values, "date", *V.DATE_NEIGHBOUR_PX)))
        if "batch" in families:
            options.append(F.when((how == "batch") & F.col("v_batch").isNull(),
                                  nearest_value(blocks, values, "batch", *V.BATCH_NEIGHBOUR_PX)))
        near = F.coalesce(*options) if options else near
    return hits.withColumn("near", near if "near_values" in hits.columns else near.cast(_NEAR.format(id="string")))


def _emissions(hits: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Candidates of the normalised hits: one row, or two for an organisation with an address."""
    kind, ext, how, raw, multi, near = (F.col(c) for c in ("kind", "ext", "how", "raw", "is_multi_line", "near"))
    have = set(hits.columns)

    def v(name: str, field: str | None = None) -> Column:
        if name not in have:
            return F.lit(None)
        return F.col(name) if field is None else F.col(name)[field]

    def by_line(single: float, several: float) -> Column:
        return F.when(multi, several).otherwise(single)

    nearby = near.isNotNull()
    date = (lambda f: F.coalesce(v("v_date", f), F.when(how == "date", near["date"][f]))) if "v_date" in have else (lambda f: F.lit(None))
    code = F.coalesce(v("v_batch"), F.when(how == "batch", near["batch"])) if "v_batch" in have else F.lit(None)
    care = kind == "CONSUMER_CARE_ADDRESS"
    body = strip(F.col("text"))
    dated = date("valid").isNotNull()
    fields: dict[str, Column] = {
        **{f: v("v_mrp", f) for f in ("amount", "currency", "taxes_inclusive", "raw_amount")},
        **{f: v("v_qty", f) for f in ("value", "unit", "raw_unit", "canonical_value", "canonical_unit",
                                      "is_multipack", "multipack")},
        **{f: date(f) for f in ("date", "day", "month", "year", "format", "is_relative", "relative_duration",
                                "relative_unit", "relative_text")},
        "semantic_type": F.when(dated, kind),
        **{f: v("v_country", f) for f in ("country", "is_recognized")},
        **{f: v("v_phone", f) for f in ("number", "digits")},
        "email": v("v_email", "email"),
        **{f: v("v_org", f) for f in ("name", "pincode", "role")},
        "address": F.when(care, body).otherwise(v("v_org", "address")),
        "batch_number": code,
        "commodity_name": v("v_commodity", "commodity_name"),
        "raw": F.coalesce(*[v(c, "raw") for c in ("v_country", "v_phone", "v_email", "v_org", "v_commodity")],
                          F.when(care, body), F.when(code.isNotNull(), strip(F.coalesce(near["text"], raw)))),
        "valid": F.coalesce(*[v(c, "valid") for c in ("v_mrp", "v_qty", "v_country", "v_phone", "v_email", "v_org", "v_commodity")],
                            F.when(dated | code.isNotNull(), True)),
    }
    fields = {f: c for f, c in fields.items()}
    good = (
        v("v_mrp", "amount").isNotNull() | v("v_qty").isNotNull() | v("v_country").isNotNull() | dated
        | v("v_org").isNotNull() | F.coalesce(v("v_phone", "valid").cast("boolean"), F.lit(False)) | v("v_email").isNotNull()
        | care | code.isNotNull() | F.coalesce(v("v_commodity", "valid").cast("boolean"), F.lit(False))
    )
    labelled = how == "labelled"
    has_unit = v("v_qty", "unit").isNotNull()
    valid = F.coalesce(fields["valid"].cast("boolean"), F.lit(False))
    known = F.coalesce(fields["is_recognized"].cast("boolean"), F.lit(False))
    qty, mrp = kind == "NET_QUANTITY", kind == "MRP"
    has_label = (
        F.when(mrp, labelled).when(qty, how.isin("multipack", "labelled")).when(kind == "CONSUMER_CARE_EMAIL", labelled)
        .otherwise(F.lit(True))
    )
    pattern = (
        F.when(mrp, F.when(labelled, 1.0).otherwise(0.72))
        .when(qty, F.when(how == "multipack", 1.0).when(labelled, F.when(has_unit, 1.0).otherwise(0.55))
              .when(how == "counted", 0.88).otherwise(0.68))
        .when(kind == "COUNTRY_OF_ORIGIN", F.when(known, 1.0).otherwise(0.72))
        .when(how == "org", F.when(F.length(v("v_org", "name").cast("string")) > 0, 1.0).otherwise(0.65))
        .when(kind == "CONSUMER_CARE_PHONE", F.when(F.length(v("v_phone", "digits").cast("string")) >= 10, 1.0).otherwise(0.72))
        .when(kind == "CONSUMER_CARE_EMAIL", F.when(F.contains(v("v_email", "email").cast("string"), F.lit("@")), 1.0).otherwise(0.65))
        .when(care, 0.82).when(kind == "COMMODITY_NAME", 0.88).otherwise(1.0)
    )
    spatial = (
        F.when(mrp, F.when(labelled, by_line(1.0, 0.9)).otherwise(1.0))
        .when(qty, F.when(how == "multipack", by_line(1.0, 0.95)).when(labelled, by_line(1.0, 0.9)).otherwise(1.0))
        .when(how == "org", by_line(1.0, 0.92)).when(care, 0.88).when(nearby, 0.9).otherwise(1.0)
    )
    validity = (
        F.when(qty & labelled & ~has_unit, 0.6)
        .when(qty & ~valid, F.when(how == "counted", 0.5).otherwise(0.4))
        .when(kind == "COUNTRY_OF_ORIGIN", F.when(known, 1.0).otherwise(0.6))
        .when((how == "org") & ~valid, 0.55).when((kind == "CONSUMER_CARE_EMAIL") & ~valid, 0.5)
        .when(care, 0.85).otherwise(1.0)
    )
    raw_value = (
        F.when(qty, F.when(how == "multipack", body).otherwise(F.concat_ws(" ", raw, F.col("unit"))))
        .when(how == "org", v("v_org", "name").cast("string")).when(care, body)
        .when(how == "batch", code.cast("string")).when(how == "date", F.coalesce(near["text"], raw))
        .when(kind == "COMMODITY_NAME", v("v_commodity", "commodity_name").cast("string"))
        .when(mrp, raw).otherwise(strip(raw))
    )
    address = v("v_org", "address").cast("string")
    with_address = (how == "org") & (address != "") & (address != v("v_org", "name").cast("string"))

    # everything a caller may filter on lies in the exploded struct: such a filter stays above the generator
    shared = [
        _superset(**fields).alias("normalized"),
        has_label.alias("has_label"), pattern.alias("pattern"), spatial.alias("spatial"), validity.alias("validity"),
        F.coalesce(near["text"], F.col("text")).alias("raw_text"),
        F.when(nearby, "nearby_block").alias("spatial_relation"),
        F.when(nearby, F.concat(_evidence(F.col("blocks")), F.array(_evidence_of(near)))).otherwise(_evidence(F.col("blocks"))).alias("blocks"),
    ]

    def row(dtype: Column, ext_seq: Column, value: Column) -> Column:
        return F.struct(dtype.alias("declaration_type"), ext_seq.alias("ext_seq"), value.alias("raw_value"), "__shared")

    name = F.when(how == "org", F.concat(kind, F.lit("_NAME"))).otherwise(kind)
    rows = F.array(
        F.when(good, row(name, ext, raw_value)),
        F.when(with_address, row(F.concat(kind, F.lit("_ADDRESS")), ext + 1, address)),
    )
    keep = [*[c for c in _IMAGE if c in hits.columns], *_ORDER, "ocr_conf"]
    return (
        hits.withColumn("__shared", F.struct(*shared))
        .select(*keep, F.explode_outer(rows).alias("__e"))
        .where("__e is not null")
        .select(*keep, "__e.declaration_type", "__e.ext_seq", "__e.raw_value", "__e.__shared.*")
    )


def _evidence_of(b: Column) -> Column:
    return F.struct(*[b[c].alias(c) for c in ("block_id", "x1", "y1", "x2", "y2")])


def _evidence(blocks: Column) -> Column:
    return F.transform(blocks, _evidence_of)


_IMAGE = ("scan_id", "image_id", "image_type", "image_seq")
_ORDER = ("stage", "a", "b", "c")


def _score(rows: DataFrame) -> DataFrame:
    """Confidence, level, breakdown and evidence of emitted rows."""
    ocr, label, pattern, spatial, validity = (
        F.col(c) for c in ("ocr_conf", "has_label", "pattern", "spatial", "validity"))
    no_unit = (F.col("declaration_type") == "NET_QUANTITY") & label & F.col("normalized.unit").isNull()
    level = S.level_of(F.col("confidence"))
    return (
        rows.withColumn("confidence", S.confidence(ocr, label, pattern, spatial, validity))
        .withColumn("box", S.union_bbox(F.col("blocks")))
        .select(
            *[c for c in _IMAGE if c in rows.columns], "declaration_type", "raw_text", "raw_value", "normalized",
            "confidence",
            F.when(no_unit & (level == "HIGH"), "MEDIUM").otherwise(level).alias("confidence_level"),
            S.breakdown(ocr, label, pattern, spatial, validity).alias("breakdown"),
            "spatial_relation",
            F.transform("blocks", lambda b: b["block_id"]).alias("block_ids"),
            "box.x1", "box.y1", "box.x2", "box.y2", *_ORDER, "ext_seq",
        )
    )


def candidates_from_spans(spans: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """EXT1 to EXT14 on any span table; a ``near_values`` column enables the search in nearby blocks."""
    # a mean over an array per span would cost more than the guards; it is taken for spans with hits
    hits = find_hits(spans.drop("ocr_conf"), families).withColumn("ocr_conf", ocr_confidence(F.col("blocks")))
    return _score(_emissions(_near_columns(_value_columns(hits, families), families), families))


#: Bits of a line: a digit, then the words (and shapes of numbers) that a span with a hit of the family has in one of its lines.
_DIGIT, _PRICE, _CURRENCY, _LABELLED_QTY, _COUNTRY, _DATE, _SHELF_LIFE, _ORG, _CONTACT, _CARE, _BATCH, _COMMODITY = (1 << i for i in range(12))


def line_marks(families: tuple[str, ...]) -> tuple[Column, Callable[[Column, Column], Column]]:
    """Marks of a line's ``text`` for :func:`candidate_spans`, and which spans can have hits of the families.

    These are the guards of the anchors, judged once per line. None of their words holds white space, so a word of a span lies in one of its lines.
    """
    text = F.col("text")
    upper = F.replace(F.upper(text), F.lit("\u212a"), F.lit("K"))
    dates = [w for words in _DATE_GUARD.values() for w in words]
    tests = {
        "mrp": {_DIGIT: _has_digit(text), _PRICE: _any(upper, *_PRICE_GUARD), _CURRENCY: _any(upper, *_CURRENCY_GUARD)},
        "quantity": {_DIGIT: _has_digit(text), _LABELLED_QTY: _any(upper, *_MULTIPACK_GUARD, *_QTY_GUARD)},
        "country": {_COUNTRY: _any(upper, *_COUNTRY_GUARD)},
        "dates": {_DIGIT: _has_digit(text), _DATE: _any(upper, *dates), _SHELF_LIFE: _any(upper, *_SHELF_LIFE_GUARD)},
        "organisations": {_ORG: _any(upper, *{w for words in _ORG_GUARD.values() for w in words})},
        # the space of a toll-free number may be the end of a line
        "care": {_CONTACT: text.rlike("800|[6-9][0-9]{4}|0[0-9]{2}") | _maybe_email(text), _CARE: _any(upper, *_CARE_GUARD)},
        "batch": {_BATCH: _any(upper, *_BATCH_GUARD)},
        "commodity": {_COMMODITY: _any(upper, *_COMMODITY_GUARD)},
    }
    bits = {bit: test for f in families for bit, test in tests[f].items()}
    marks = F.lit(0)
    for bit, test in bits.items():
        marks = marks.bitwiseOR(F.when(test, bit).otherwise(0))

    def wanted(marks: Column, n_blocks: Column) -> Column:
        def has(bit: int) -> Column:
            return marks.bitwiseAND(bit) != 0

        digit, short = has(_DIGIT), n_blocks <= 2
        rules = {
            "mrp": digit & (has(_PRICE) | (short & has(_CURRENCY))), "quantity": digit & (short | has(_LABELLED_QTY)),
            "dates": has(_DATE) | (digit & has(_SHELF_LIFE)), "care": has(_CONTACT | _CARE),
            "country": has(_COUNTRY), "organisations": has(_ORG), "batch": has(_BATCH), "commodity": has(_COMMODITY),
        }
        out = F.lit(False)
        for f in families:
            out = out | rules[f]
        return out

    return marks, wanted


def extract_candidates(blocks: DataFrame, families: tuple[str, ...] = FAMILIES, px: int = STRIP_PX) -> DataFrame:
    """EXT0: every declaration candidate of every image, before arbitration."""
    near = near_value(dict(blocks.dtypes)["block_id"]) if {"dates", "batch"} & set(families) else None
    marks, wanted = line_marks(families)
    spans = span_rows(blocks, px=px, near=near, near_guard=_NEAR_GUARD, marks=marks, wanted=wanted)
    return candidates_from_spans(spans, families)
