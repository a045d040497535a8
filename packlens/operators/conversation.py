"""Chat messages: intents, history windows and selection of scan context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packlens.functions import fixed_values as V
from packlens.functions.text import any_of, ci, count_of, strip, truncate_message

INTENT = (
    "struct<intent:string,target_fields:array<string>,panel_referenced:string,rewritten:boolean,"
    "requires_scan_data:boolean,requires_legal_rules:boolean,confidence:double>"
)


def target_fields(lower: Column) -> Column:
    """NLP1: field tags, one alternation per tag."""
    return F.array_compact(F.array(*[F.when(lower.rlike(any_of(p)), tag) for tag, p in V.FIELD_PATTERNS.items()]))


def panel_ref(lower: Column) -> Column:
    """NLP2: first panel named, in fixed order."""
    return F.coalesce(*[F.when(lower.rlike(any_of(p)), panel) for panel, p in V.PANEL_PATTERNS.items()])


def rewrite_query(message: Column, product: Column) -> Column:
    """NLP4: pronouns become the quoted product name (the name is taken literally)."""
    query = strip(message)
    literal = F.regexp_replace(product, r"([\\$])", r"\\$1")
    named = F.regexp_replace(query, F.lit(ci(V.PRONOUNS)), F.concat(F.lit("'"), literal, F.lit("'")))
    return F.when(F.length(product) > 0, named).otherwise(query)


def classify_intents(messages: DataFrame, text: str = "text", product: str = "product_name") -> DataFrame:
    """NLP3: nine ordered checks; adds intent, target_fields, panel_referenced, rewritten_query and flags."""
    lower, prod = F.col("__lower"), F.col(product)
    has_product = F.coalesce(F.length(prod) > 0, F.lit(False))
    staged = messages.withColumn("__lower", F.lower(strip(F.col(text)))).withColumns({
        "__fields": target_fields(F.col("__lower")), "__panel": panel_ref(F.col("__lower")),
        "__words": count_of(F.col("__lower"), r"(?U)\b\w+\b"),
        "__legal": F.col("__lower").rlike(any_of(V.LEGAL_PATTERNS)),
    })
    fields, panel, n_words, legal = F.col("__fields"), F.col("__panel"), F.col("__words"), F.col("__legal")
    no_field = F.size(fields) == 0
    none = F.array().cast("array<string>")

    def result(intent: str, fld: Column, pnl: Column, rewritten: bool, scan: Column | bool, rules: bool, conf: float) -> Column:
        return F.struct(
            F.lit(intent).alias("intent"), fld.alias("target_fields"), pnl.cast("string").alias("panel_referenced"),
            F.lit(rewritten).alias("rewritten"), (scan if isinstance(scan, Column) else F.lit(scan)).alias("requires_scan_data"),
            F.lit(rules).alias("requires_legal_rules"), F.lit(conf).alias("confidence"))

    null = F.lit(None)
    price_question = F.array_contains(fields, "mrp") & (n_words > 8)
    focused = F.contains(lower, F.lit("this")) | F.contains(lower, F.lit("my")) | F.contains(lower, F.lit("it"))
    names_product = has_product & F.contains(lower, F.lower(prod))
    choice = (
        F.when(lower.rlike(any_of(V.POLITENESS_PATTERNS)) & (n_words <= 4) & no_field,
               result("POLITENESS_OR_THANKS", none, null, False, False, False, 0.98))
        .when(lower.rlike(any_of(V.GREETING_PATTERNS)) & (n_words <= 5) & no_field,
              result("GREETING_OR_CHITCHAT", none, null, False, has_product, False, 0.99))
        .when(lower.rlike(any_of(V.CAPABILITY_PATTERNS)) & no_field,
              result("SYSTEM_NAVIGATION_HELP", none, null, False, False, False, 0.95))
        .when(lower.rlike(any_of(V.QUALITY_PATTERNS)) & ~price_question,
              result("IMAGE_QUALITY_DIAGNOSTIC", fields, panel, False, True, False, 0.92))
        .when(legal & ~has_product & ~focused,
              result("LEGAL_REGULATION_INQUIRY", fields, panel, False, False, True, 0.94))
        .when(~no_field, result("SPECIFIC_DECLARATION_CHECK", fields, panel, True, True, True, 0.95))
        .when(legal, result("LEGAL_REGULATION_INQUIRY", none, panel, False, False, True, 0.90))
        .when(lower.rlike(any_of(V.OVERVIEW_PATTERNS)) | names_product,
              result("PRODUCT_COMPLIANCE_OVERVIEW", none, panel, True, True, True, 0.88))
        .otherwise(result("GENERAL_KNOWLEDGE", none, panel, False, has_product, True, 0.75))
    )
    return (
        staged.withColumn("__r", choice.cast(INTENT))
        .withColumn("rewritten_query", F.when(F.col("__r.rewritten"), rewrite_query(F.col(text), prod)).otherwise(strip(F.col(text))))
        .select(*messages.columns, "__r.intent", "__r.target_fields", "__r.panel_referenced", "rewritten_query",
                "__r.requires_scan_data", "__r.requires_legal_rules", "__r.confidence")
    )


def prune_history(messages: DataFrame) -> DataFrame:
    """WIN4, SC18: last eight messages per conversation, roles folded, long texts cut with a marker.

    The cut and the window are the feature itself; the rank filter limits every task before the shuffle.
    """
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (
        messages.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= V.HISTORY_MESSAGES)
        .select("conv_id", "turn", F.when(F.lower("role").isin("user", "human"), "user").otherwise("assistant").alias("role"),
                truncate_message(F.col("text"), V.HISTORY_CHARS).alias("content"))
    )


# ----------------------------------------------------------------- context (NLP5 to NLP7)
def field_matches(fields: Column, dtype: Column) -> Column:
    """NLP7: does a declaration type answer one of the asked fields?"""
    upper = F.upper(dtype)
    out = F.lit(False)
    for field, parts in V.FIELD_TYPE_PARTS.items():
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(upper, F.lit(part))
        out = out | (F.array_contains(fields, field) & hit)
    return out


def base_header(product: Column, brand: Column, status: Column) -> Column:
    """NLP6: first line of every context."""
    with_brand = F.when(F.length(brand) > 0, F.concat(F.lit(" ("), brand, F.lit(")"))).otherwise("")
    return F.concat(F.lit("Active Product: "), product, with_brand, F.lit(" | Session Status: "), status)


def select_declarations(questions: DataFrame, decls: DataFrame) -> DataFrame:
    """NLP5, TOPK1: declarations shown for a question about fields (at most six, in stored order).

    ``questions``: question_id, scan_id, target_fields. ``decls``: scan_id, declaration_type, raw_text,
    confidence, resolution_status, seq.
    """
    hits = questions.join(decls.hint("merge"), "scan_id").where(field_matches(F.col("target_fields"), F.col("declaration_type")))
    w = W.partitionBy("question_id").orderBy("seq")
    line = F.concat(F.lit("• ["), F.upper("declaration_type"), F.lit("] '"), "raw_text", F.lit("' (Confidence: "),
                    F.format_string("%.2f", "confidence"), F.lit(", Review: "), "resolution_status", F.lit(")"))
    return (
        hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= V.CONTEXT_CAPS["matched"])
        .select("question_id", "pos", line.alias("line"))
    )


def _with_headings(rows: DataFrame) -> DataFrame:
    """Every section's first line is preceded by its heading, as line 0."""
    names = F.create_map(*[x for k, v in V.CONTEXT_HEADINGS.items() for x in (F.lit(k), F.lit(v))])
    own = F.struct("pos", "line")
    head = F.struct(F.lit(0).alias("pos"), F.element_at(names, F.col("section")).alias("line"))
    return rows.select("question_id", "section", F.inline(F.when(F.col("pos") == 1, F.array(head, own)).otherwise(F.array(own))))


def select_context(questions: DataFrame, scans: DataFrame, quality: DataFrame, decls: DataFrame, findings: DataFrame,
                   keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """NLP5, NLP6: context lines per question, numbered, with the intent's selection, headings and caps.

    ``questions``: question_id, scan_id, intent, target_fields, panel_referenced, requires_scan_data. ``findings``: scan_id,
    rule_code, status, message. Returns (question_id, section, pos, line); joining the lines of a question by newline
    is its context. A field question about a scan without declarations is answered like an overview.

    Every section reads the questions with their scans; ``keep`` can store these rows, so that they are made once. Tables of one row a scan
    or more are merged, not broadcast: compressed they look small, but each would be a hash table of every scan in the driver.
    """
    stored = decls.select("scan_id").distinct().withColumn("has_decls", F.lit(True))
    q = questions.join(scans.select("scan_id", "product", "brand", "status").hint("merge"), "scan_id").join(stored.hint("merge"), "scan_id", "left")
    silent = F.col("intent").isin("SYSTEM_NAVIGATION_HELP", "LEGAL_REGULATION_INQUIRY") & ~F.col("requires_scan_data")
    active = keep(q.where(~silent))
    header = active.select("question_id", F.lit(0).alias("section"), F.lit(0).alias("pos"),
                           base_header(F.col("product"), F.col("brand"), F.col("status")).alias("line"))
    specific = (F.col("intent") == "SPECIFIC_DECLARATION_CHECK") & F.col("has_decls").isNotNull()
    asked = active.where(specific).select("question_id", "scan_id", "target_fields")
    broad = active.where(~specific & ~F.col("intent").isin("GREETING_OR_CHITCHAT", "POLITENESS_OR_THANKS", "IMAGE_QUALITY_DIAGNOSTIC"))

    def capped(rows: DataFrame, section: int, cap: int, line: Column, order: str = "seq") -> DataFrame:
        w = W.partitionBy("question_id").orderBy(order)
        return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap).select(
            "question_id", F.lit(section).alias("section"), "pos", line.alias("line"))

    panel = F.coalesce("panel_type", F.concat(F.lit("Panel "), F.col("pos").cast("string")))
    marked = F.when(F.coalesce(F.contains(F.upper(panel), F.col("panel_referenced")), F.lit(False)), "▶ ").otherwise("• ")
    flags = F.when(F.size("warnings") > 0, F.concat(
        F.lit(", Flags: ['"), F.array_join("warnings", "', '"), F.lit("']"))).otherwise("")
    q_line = F.concat(marked, panel, F.lit(": Status="), "quality_status", F.format_string(
        ", BlurScore=%.1f (min 100), GlareRatio=%.1f%% (max 5.0%%)", "blur_score", F.col("glare_score") * 100), flags)
    quality_rows = capped(
        active.where("intent = 'IMAGE_QUALITY_DIAGNOSTIC'").join(quality.hint("merge"), "scan_id"), 1, V.CONTEXT_CAPS["quality"], q_line)
    matched = select_declarations(asked, decls).select("question_id", F.lit(2).alias("section"), "pos", "line")
    note = asked.join(matched.where("pos = 1").select("question_id").hint("merge"), "question_id", "left_anti").select(
        "question_id", F.lit(2).alias("section"), F.lit(0).alias("pos"),
        F.concat(F.lit(V.CONTEXT_NOTE[0]), F.array_join("target_fields", ", "), F.lit(V.CONTEXT_NOTE[1])).alias("line"))
    f_line = F.concat(F.lit("• Rule "), "rule_code", F.lit(" ["), F.col("finding_status"), F.lit("]: "), "message")
    found = findings.select("scan_id", "rule_code", F.col("status").alias("finding_status"), "message")
    violated = F.col("finding_status").isin("FAIL", "REVIEW")
    about = F.exists("target_fields", lambda x: F.contains(F.col("rule_code"), F.upper(x)))
    applicable = capped(asked.join(found.hint("merge"), "scan_id").where(about | violated), 3, V.CONTEXT_CAPS["findings"], f_line, "rule_code")
    o_line = F.concat(F.lit("• ["), F.upper("declaration_type"), F.lit("]: '"), F.left("raw_text", F.lit(70)),
                      F.lit("' (Conf: "), F.format_string("%.2f", "confidence"), F.lit(")"))
    overview = capped(broad.select("question_id", "scan_id").join(decls.hint("merge"), "scan_id"), 4, V.CONTEXT_CAPS["overview"], o_line)
    issues = capped(broad.select("question_id", "scan_id").join(found.where(violated).hint("merge"), "scan_id"), 5, V.CONTEXT_CAPS["violations"], f_line, "rule_code")
    body = quality_rows.unionByName(matched).unionByName(applicable).unionByName(overview).unionByName(issues)
    return header.unionByName(note).unionByName(_with_headings(body))


def context_counts(questions: DataFrame, quality: DataFrame, decls: DataFrame, findings: DataFrame) -> DataFrame:
    """AGG20: questions with the numbers their savings depend on."""
    nd = decls.groupBy("scan_id").agg(F.count("*").alias("n_decl"))
    nq = quality.groupBy("scan_id").agg(F.count("*").alias("n_quality"))
    nf = findings.groupBy("scan_id").agg(F.count("*").alias("n_findings"), F.count_if(F.col("status").isin("FAIL", "REVIEW")).alias("n_violations"))
    hits = questions.where("intent = 'SPECIFIC_DECLARATION_CHECK'").join(decls, "scan_id").where(field_matches(F.col("target_fields"), F.col("declaration_type")))
    nm = hits.groupBy("question_id").agg(F.count("*").alias("n_matched"))
    joined = questions.join(nq, "scan_id").join(nd, "scan_id", "left").join(nf, "scan_id", "left").join(nm, "question_id", "left")
    return joined.na.fill(0, ["n_decl", "n_findings", "n_violations", "n_matched"])


def finding_lines(findings: DataFrame) -> DataFrame:
    """FLT8: violations of a scan, at most five, as context lines."""
    w = W.partitionBy("scan_id").orderBy("rule_code")
    return (
        findings.where(F.col("status").isin("FAIL", "REVIEW")).withColumn("pos", F.row_number().over(w))
        .where(F.col("pos") <= V.CONTEXT_CAPS["violations"])
        .select("scan_id", "pos", F.concat(F.lit("• Rule "), "rule_code", F.lit(" ["), "status", F.lit("]: "), "message").alias("line"))
    )
