"""Queries of field extraction and mail planning, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sqltext as S
from tidemark.operators import consolidate, extract, mail
from tidemark.plans.oracle import STEPS, oracle

P = extract.PATTERNS
_f = lambda n: f"nullif(trim(regexp_extract(text, $p${P[n]}$p$, 1)), '')"
_n = lambda n: f"try_cast(replace({_f(n)}, ',', '') AS DOUBLE)"
_l = "lower(text)"
_kw = lambda ks: f"({S.hits(_l, ks)})[1]"
_amount = lambda k: f"try_cast(regexp_replace(replace(regexp_extract_all(text, $p${P['amount']}$p$)[{k}], ',', ''), '[A-Z ]', '', 'g') AS DOUBLE)"
LABELS = ("insured", "cedant", "broker", "perils", "geo_limit", "situation", "period")
NUMBERS = ("sum_insured", "premium", "excess", "retention")
_near = ", ".join(f"CASE WHEN instr({_l}, '{w}') > 0 THEN try_cast(nullif(regexp_extract(substr(text, greatest(1, instr({_l}, '{w}') - 50), CASE WHEN instr({_l}, '{w}') > 50 THEN 150 ELSE instr({_l}, '{w}') + 99 END), $p${P['percent']}$p$, 1), '') AS DOUBLE) END" for w in extract.PML_WORDS)
STEPS["slip_found"] = "SELECT *, " + ", ".join(f"len(regexp_extract_all(text, $p${p}$p$)) AS n_{n}" for n, p in extract.SLIP_PATTERNS.items()) + f", {S.hits(_l, extract.PRIMARY)} AS prim, {S.hits(_l, extract.SECONDARY)} AS sec, CASE " + " ".join(f"WHEN lower(string_split(filename, '.')[-1]) IN ({', '.join(map(repr, e))}) THEN '{n}'" for n, e in extract.FORMATS.items()) + " ELSE 'other' END AS fmt FROM slips"
_patterns = " + ".join(f"CASE WHEN n_{n} > 0 THEN {0.1 if n in ('reference', 'sum_insured') else 0.05} ELSE 0 END" for n in extract.SLIP_PATTERNS)
_checks = [("n_reference > 0", 0.2, "No reference number found"), ("n_sum_insured > 0 OR n_percentage > 0", 0.25, "No financial data (sum insured/percentages) found"), (f"n_cedant > 0 OR contains({_l}, 'reinsurer')", 0.2, "No party information (cedant/reinsurer) found"), (S.has(_l, "coverage", "perils", "risks covered", "policy"), 0.15, "No coverage details found"), ("n_period > 0", 0.1, "No period/date information found"), ("len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) > 50", 0.1, "Document appears too short or poorly structured")]
STEPS["slip_scored"] = f"""
    SELECT *, round(least(1::DOUBLE, least(len(prim) * 0.3::DOUBLE, 0.6) + least(len(sec) * 0.05::DOUBLE, 0.2) + least(({_patterns})::DOUBLE, 0.25) + CASE WHEN fmt IN ('pdf', 'docx') THEN 0.1 WHEN fmt = 'other' THEN 0 ELSE 0.05 END), 4) AS confidence,
           CASE {' '.join(f"WHEN len(list_filter(prim, lambda k: contains(k, '{t}'))) > 0 THEN '{t}'" for t in extract.SLIP_TYPES)} WHEN len(prim) > 0 THEN 'unknown' END AS kind,
           round(({' + '.join(f'CASE WHEN {a} THEN {w} ELSE 0 END' for a, w, _ in _checks)})::DOUBLE, 4) AS quality, {S.listed(*((f'NOT ({a})', f"'{i}'") for a, _, i in _checks))} AS issues FROM slip_found"""
MESSAGE = "application_id"
SCHEMA = "insured string, tsi double"


def slips_of(t):
    return extract.slips(t.slips)


def planned_of(t):
    return extract.plan(slips_of(t), MESSAGE, "doc_id")


def answers(t):
    """A model's answer on each slip: what the slip says, fenced, in a sentence, or not as JSON."""
    given = F.to_json(F.struct(F.regexp_extract("text", P["insured"], 1).alias("insured"), F.regexp_replace(F.regexp_extract("text", P["sum_insured"], 1), ",", "").cast("double").alias("tsi")))
    turn = F.col("doc_id") % 3
    return t.slips.select("doc_id", F.when(turn == 0, F.concat(F.lit("```json\n"), given, F.lit("\n```"))).when(turn == 1, F.concat(F.lit("Here it is: "), given, F.lit(" done"))).otherwise(F.col("text")).alias("answer"))


#: Keywords, characters before and after, the longest text, further evidence (words, how many, weight) of each topic.
TOPICS = {
    "cat": (extract.CAT_WORDS, 30, 150, 300, [(extract.CAT_MODELS, 1, 0.15)]),
    "climate": (extract.CLIMATE_WORDS, 40, 160, 500, [(extract.CLIMATE_LEVELS, 1, 0.15), (extract.CLIMATE_FRAMES, 1, 0.1)]),
    "esg": (extract.ESG_WORDS, 40, 160, 500, [(extract.ESG_SIGNS, 1, 0.15), (extract.ESG_PARTS, 2, 0.1)]),
}


def topics(t, name):
    return extract.topic(t.slips, name, *TOPICS[name])


def topic_sql(name):
    words, before, after, most, extra = TOPICS[name]
    sure = "0.5 + 0.1 * len(around)"
    for keys, least, weight in extra:
        sure = f"least(1.0, {sure} + CASE WHEN len({S.hits(f'lower({name})', keys)}) >= {least} THEN {weight} ELSE 0 END)"
    return f"""
    SELECT doc_id, {name}, CASE WHEN len(around) > 0 THEN round(({sure})::DOUBLE, 4) ELSE 0 END::DOUBLE AS {name}_confidence FROM (
        SELECT *, CASE WHEN len(around) > 0 THEN CASE WHEN length(whole) > {most} THEN substr(whole, 1, {most - 3}) || '...' ELSE whole END END AS {name} FROM (
            SELECT *, trim(regexp_replace(array_to_string(around, '; '), '\\s+', ' ', 'g')) AS whole FROM (
                SELECT doc_id, list_transform(({S.hits(_l, words)})[1:3], lambda k: regexp_replace(substr(text, greatest(1, instr({_l}, k) - {before}), least(instr({_l}, k) - 1, {before}) + {after}), '^\\s+|\\s+$', '', 'g')) AS around FROM slips)))"""


def money_sql(key, given):
    """given: a SELECT of the key and given."""
    return f"""
    SELECT {key}, try_cast(CASE WHEN european THEN replace(replace(digits, '.', ''), ',', '.') ELSE replace(digits, ',', '') END AS DOUBLE) AS amount,
           coalesce(nullif(regexp_extract(upper(given), '\\b(USD|EUR|GBP|KES|JPY)\\b', 1), ''), CASE WHEN contains(given, '$') THEN 'USD' WHEN contains(given, '€') THEN 'EUR' WHEN contains(given, '£') THEN 'GBP' END) AS currency
    FROM (SELECT *, CASE WHEN contains(digits, ',') AND contains(digits, '.') THEN length(split_part(digits, ',', -1)) < length(split_part(digits, '.', -1))
                         WHEN contains(digits, ',') THEN length(split_part(digits, ',', -1)) <= 2 AND length(digits) - length(replace(digits, ',', '')) = 1 ELSE false END AS european
          FROM (SELECT *, regexp_replace(given, '[^0-9.,]', '', 'g') AS digits FROM ({given})))"""


#: How a slip's date is written: the nine formats in turn, for Spark and for SQL.
WRITTEN = [("MM/dd/yyyy", "%m/%d/%Y"), ("dd/MM/yyyy", "%d/%m/%Y"), ("yyyy-MM-dd", "%Y-%m-%d"), ("MM-dd-yyyy", "%m-%d-%Y"), ("dd-MM-yyyy", "%d-%m-%Y"), ("yyyy/MM/dd", "%Y/%m/%d"), ("dd MMM yyyy", "%d %b %Y"), ("dd MMMM yyyy", "%d %B %Y"), ("MMM dd, yyyy", "%b %d, %Y")]


def written_dates(t):
    turn = F.pmod("doc_id", F.lit(len(WRITTEN)))
    return F.coalesce(*(F.when(turn == n, F.date_format("uploaded_at", java)) for n, (java, _) in enumerate(WRITTEN)))


def written_amounts(t):
    """The amounts of each slip, every second one in European notation."""
    once = t.slips.select("doc_id", "text", extract.percentage("text").alias("percentage"))
    each = once.select("doc_id", "percentage", F.posexplode(F.regexp_extract_all("text", F.lit(extract.quick("amount")), F.lit(0))).alias("place", "amount"))
    return each.select("doc_id", "place", "percentage", F.when((F.col("doc_id") + F.col("place")) % 2 == 1, F.translate("amount", ",.", ".,")).otherwise(F.col("amount")).alias("given"))



SECTION_WORDS = ["the", "and", "der", "une", "los"]
BEST_WORDS = ["the", "der"]
QUERIES = {
    "x1_basic_fields": lambda t: extract.basic_fields(t.slips).select("doc_id", "reference", "first_date", "location", "mails"),
    "x2_amounts": lambda t: extract.basic_fields(t.slips).select("doc_id", "amount_1", "amount_2", "amount_3", "currency"),
    "x3_dates": lambda t: t.slips.select("doc_id", written_dates(t).alias("given")).select("doc_id", "given", extract.parsed_date(F.col("given")).alias("parsed")),
    "x4_money": lambda t: written_amounts(t).select("doc_id", "place", "given", extract.parsed_money(F.col("given")).alias("amount"), extract.currency_of(F.col("given")).alias("currency"), "percentage"),
    "x5_parties": lambda t: extract.labelled_fields(t.slips).select("doc_id", "insured", "cedant", "broker", "insured_company", "cedant_company", "broker_company"),
    "x6_coverage": lambda t: extract.labelled_fields(t.slips).select("doc_id", "coverage", "line_of_business", "treaty"),
    "x7_clean_names": lambda t: extract.labelled_fields(t.slips).select("doc_id", extract.clean_name(F.concat(F.lit(" "), F.lower("insured"), F.lit(" ,"))).alias("name")),
    "x8_texts": lambda t: extract.labelled_fields(t.slips).select("doc_id", "perils", "geo_limit", "situation"),
    "x9_terms": lambda t: extract.labelled_fields(t.slips).select("doc_id", "sum_insured", "premium", "excess", "retention", "rate", "period"),
    "x10_keyword_fallback": lambda t: extract.labelled_fields(t.slips).select("doc_id", "peril_words", "occupation"),
    "x11_pml": lambda t: extract.pml(t.slips).select("doc_id", "pml", "pml_confidence"),
    "x12_cat_exposure": lambda t: topics(t, "cat").select("doc_id", "cat", "cat_confidence"),
    "x13_period": lambda t: extract.period(t.slips).select("doc_id", "period", "period_confidence"),
    "x14_deductions": lambda t: extract.deductions(t.slips).select("doc_id", "deduction", "deduction_confidence"),
    "x15_claims": lambda t: extract.claims(t.slips).select("doc_id", "claims", "claims_confidence"),
    "x16_share": lambda t: extract.share_offered(t.slips).select("doc_id", "share", "share_confidence"),
    "x17_survey": lambda t: extract.survey(t.slips).select("doc_id", "survey", "survey_file", "survey_confidence"),
    "x18_climate": lambda t: topics(t, "climate").select("doc_id", "climate", "climate_confidence"),
    "x19_esg": lambda t: topics(t, "esg").select("doc_id", "esg", "esg_confidence"),
    "x20_extraction_confidence": lambda t: extract.all_fields(t.slips).select("doc_id", "extraction_confidence", "missing_fields"),
    "x22_labels": lambda t: extract.labelled_fields(t.slips).select("doc_id", "insured", "sum_insured", "retention", "perils", "situation"),
    "x23_largest_amount": lambda t: extract.largest_amount(t.slips).select("doc_id", "largest", "largest_currency"),
    "x24_money_forms": lambda t: t.premium_rows.select("row_id", F.concat(F.coalesce("currency", F.lit("$")), F.lit(" "), F.format_number("tsi", 2)).alias("given")).select("row_id", extract.parsed_money(F.col("given")).alias("amount"), extract.currency_of(F.col("given")).alias("currency")),
    "x25_slip_indicators": lambda t: slips_of(t).select("doc_id", *(f"n_{n}" for n in extract.SLIP_PATTERNS), F.size("primary").alias("n_primary"), F.size("secondary").alias("n_secondary")),
    "x26_slip_confidence": lambda t: slips_of(t).select("doc_id", "confidence"),
    "x27_slip_type": lambda t: slips_of(t).select("doc_id", "kind"),
    "x28_slip_quality": lambda t: slips_of(t).select("doc_id", "quality", F.array_join("issues", "|").alias("issues"), "valid"),
    "x29_slip_priority": lambda t: slips_of(t).select("doc_id", "is_slip", "priority", F.array_join("reasons", "; ").alias("reasons")),
    "x30_format": lambda t: t.slips.select("doc_id", extract.document_format("filename").alias("format"), extract.document_type("text", "filename").alias("type")),
    "x31_plan_summary": lambda t: extract.plan_summary(planned_of(t), MESSAGE).select(MESSAGE, "documents", "slips", "seconds", "advice"),
    "x32_mail_extraction": lambda t: consolidate.first_values(extract.plan(extract.labelled_fields(slips_of(t)), MESSAGE, "doc_id"), MESSAGE, ["place"], ["insured", "cedant", "broker", "sum_insured", "premium"]),
    "x33_section_scores": lambda t: extract.section_scores(t.documents, SECTION_WORDS, separator="\n").select("doc_id", "place", "score"),
    "x34_truncation": lambda t: extract.truncated(t.documents, BEST_WORDS, 2000, separator="\n").select("doc_id", F.length("truncated").alias("n"), F.sha2("truncated", 256).alias("truncated_sha256")),
    "x35_migration": lambda t: extract.labelled_fields(t.slips).select("doc_id", F.coalesce("insured", "broker").alias("insured_name"), F.coalesce("sum_insured", "premium").alias("total_sums_insured")),
    "x36_linearised": lambda t: mail.linearised(t.supplier.select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("row"), F.explode(F.array(F.struct(F.lit(0).alias("col"), F.col("s_name").alias("value")), F.struct(F.lit(1).alias("col"), F.col("s_suppkey").cast("string").alias("value")))).alias("x")).select("doc_id", "row", "x.col", "x.value")),
    "x37_entity_fields": lambda t: mail.entity_fields(t.slips.select("doc_id", F.array(F.struct(F.lit("ORG").alias("label"), F.regexp_extract("text", P["insured"], 1).alias("value"), F.lit(0.9).alias("score")), F.struct(F.lit("LOC").alias("label"), F.regexp_extract("text", P["location"], 1).alias("value"), (F.col("doc_id") % 10 / 10).alias("score")), F.struct(F.lit("MONEY").alias("label"), F.regexp_extract("text", P["premium"], 1).alias("value"), F.lit(0.8).alias("score"))).alias("entities"))),
    "w1_processing_plan": lambda t: planned_of(t).select(MESSAGE, "doc_id", "place"),
    "s13_recovered_json": lambda t: extract.recovered_json(answers(t), "answer", SCHEMA).select("doc_id", "parsed.insured", "parsed.tsi"),
    "f10_mail_screen": lambda t: mail.screened(t.messages).select("message_id", "turn", "accepted"),
    "j14_keyword_hits": lambda t: t.slips.select("doc_id", F.array_join(extract.hits(extract.low("text"), extract.SECONDARY), "|").alias("hits")),
    "j16_attachment_refs": lambda t: mail.referenced(extract.survey(t.slips).select("doc_id", "text", F.array("filename", F.lit("survey_report.pdf")).alias("names"))),
    "a31_region_rollup": lambda t: mail.region_rollup(t.messages.select(F.col("message_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(0).alias("line"), "text", (F.length("text") % 100 / 100).alias("confidence")), 0.2).select("doc_id", F.length("text").alias("n"), F.round("confidence", 4).alias("confidence"), "regions", "pages"),
    "a32_assembled": lambda t: mail.assembled(t.messages).select("message_id", F.length("document").alias("n"), "attachments"),
}

STEPS["slip_fields"] = "SELECT doc_id, " + ", ".join([*(f"{_f(n)} AS {n}" for n in ("reference", "location", *LABELS)), *(f"{_n(n)} AS {n}" for n in NUMBERS), "list_filter(['KES', 'GBP', 'EUR', 'USD'], lambda c: contains(text, c))[1] AS currency"]) + " FROM slips"
STEPS["slip_ranked"] = """
    SELECT *, CASE WHEN NOT is_slip THEN CASE WHEN confidence >= 0.15 THEN 3 ELSE 4 END WHEN kind = 'facultative' THEN CASE WHEN ahead THEN 1 ELSE 0 END WHEN kind = 'placement' THEN CASE WHEN ahead THEN 0 ELSE 1 END ELSE 2 END AS rank
    FROM (SELECT *, coalesce(max(quality) FILTER (kind = 'placement' AND is_slip) OVER (PARTITION BY application_id) >= max(quality) FILTER (kind = 'facultative' AND is_slip) OVER (PARTITION BY application_id) + 0.15::DOUBLE, false) AS ahead
          FROM (SELECT *, confidence >= 0.3 AS is_slip FROM slip_scored))"""
STEPS["slip_plan"] = """
    SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY rank, CASE WHEN rank <= 2 THEN quality WHEN rank = 3 THEN confidence END DESC NULLS LAST, CASE WHEN rank <= 2 THEN confidence END DESC NULLS LAST, CASE WHEN rank = 4 THEN filename END NULLS FIRST, doc_id)::INT AS place FROM slip_ranked"""
STEPS["amounts"] = f"SELECT doc_id, unnest(list_zip(found, range(0, len(found)))) AS z, z[1] AS amount, z[2]::INT AS place, CASE WHEN pct BETWEEN 0 AND 100 THEN pct END AS percentage FROM (SELECT doc_id, regexp_extract_all(text, $p${P['amount']}$p$) AS found, try_cast(nullif(regexp_extract(text, $p${P['percent']}$p$, 1), '') AS DOUBLE) AS pct FROM slips)"
_join = lambda c: f"array_to_string({c}, '|') AS {c}"
STEPS["pml_parts"] = f"SELECT doc_id, {_n('pml')} AS p, coalesce({_near}) AS near FROM slips"
ORACLE = {
    "x3_dates": f"SELECT doc_id, given, try_strptime(given, {[x for _, x in WRITTEN]}) AS parsed FROM (SELECT doc_id, CASE doc_id % 9 {' '.join(f"WHEN {n} THEN strftime(uploaded_at, '{x}')" for n, (_, x) in enumerate(WRITTEN))} END AS given FROM slips)",
    "x4_money": f"SELECT doc_id, place, given, amount, currency, percentage FROM ({money_sql('doc_id, place, given, percentage', 'SELECT doc_id, place, percentage, CASE WHEN (doc_id + place) % 2 = 1 THEN translate(amount, $$,.$$, $$.,$$) ELSE amount END AS given FROM amounts')})",
    "x24_money_forms": money_sql("row_id", "SELECT row_id, coalesce(currency, '$') || ' ' || format('{:,.2f}', tsi::DOUBLE) AS given FROM premium_rows"),
    "x7_clean_names": f"""
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(joined, '[A-Za-z]+|[^A-Za-z]+'), lambda p: upper(p[1]) || lower(p[2:])), '') AS name
    FROM (SELECT doc_id, regexp_replace(trim(regexp_replace(' ' || lower({_f('insured')}) || ' ,', '\\s+', ' ', 'g')), '^[ ,.;:-]+|[ ,;:-]+$', '', 'g') AS joined FROM slips)""",
    "x12_cat_exposure": topic_sql("cat"),
    "x18_climate": topic_sql("climate"),
    "x19_esg": topic_sql("esg"),
    "x13_period": f"""
    SELECT doc_id, p AS period, CASE WHEN p IS NULL THEN 0 ELSE round(least(1::DOUBLE, CASE WHEN n >= 2 THEN 0.9 WHEN n = 1 THEN 0.8 WHEN regexp_matches(p, '(?i)[0-9]+ months?') THEN 0.7 ELSE 0.6 END::DOUBLE + CASE WHEN regexp_matches(p, '(?i)12 months|annual|from') THEN 0.1 ELSE 0 END), 4) END AS period_confidence
    FROM (SELECT doc_id, p, len(regexp_extract_all(p, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}')) AS n FROM (SELECT doc_id, {_f('period')} AS p FROM slips))""",
    "x17_survey": f"""
    SELECT doc_id, substr(s, 1, 500) AS survey, file AS survey_file, CASE WHEN s IS NULL THEN 0 WHEN file IS NOT NULL THEN 0.9 ELSE 0.7 END::DOUBLE AS survey_confidence
    FROM (SELECT doc_id, s, nullif(regexp_extract(coalesce(s, ''), '(?i)([a-z0-9_]+\\.(?:pdf|docx|xlsx))', 1), '') AS file FROM (SELECT doc_id, {_f('survey')} AS s FROM slips))""",
    "x1_basic_fields": f"SELECT doc_id, {_f('reference')} AS reference, {_f('date')} AS first_date, {_f('location')} AS location, array_to_string(regexp_extract_all(text, $p${P['email']}$p$, 1), '|') AS mails FROM slips",
    "x2_amounts": f"SELECT doc_id, {_amount(1)} AS amount_1, {_amount(2)} AS amount_2, {_amount(3)} AS amount_3, list_filter(['KES', 'GBP', 'EUR', 'USD'], lambda c: contains(text, c))[1] AS currency FROM slips",
    "x5_parties": "SELECT *, " + ", ".join(f"nullif(regexp_extract(coalesce({n}, ''), $p${extract.COMPANY}$p$, 1), '') AS {n}_company" for n in ("insured", "cedant", "broker")) + f" FROM (SELECT doc_id, {', '.join(f'{_f(n)} AS {n}' for n in ('insured', 'cedant', 'broker'))} FROM slips)",
    "x6_coverage": f"SELECT doc_id, {_kw(extract.COVERAGES)} AS coverage, {_kw(extract.COVERAGES)} AS line_of_business, {_kw(extract.TREATIES)} AS treaty FROM slips",
    "x8_texts": f"SELECT doc_id, {', '.join(f'{_f(n)} AS {n}' for n in ('perils', 'geo_limit', 'situation'))} FROM slips",
    "x9_terms": f"SELECT doc_id, {', '.join(f'{_n(n)} AS {n}' for n in NUMBERS)}, CASE WHEN {_n('rate')} BETWEEN 0 AND 100 THEN {_n('rate')} END AS rate, {_f('period')} AS period FROM slips",
    "x10_keyword_fallback": f"SELECT doc_id, array_to_string(({S.hits(_l, extract.PERIL_WORDS)})[1:10], '|') AS peril_words, {_kw(extract.OCCUPATIONS)} AS occupation FROM slips",
    "x11_pml": "SELECT doc_id, CASE WHEN v IS NOT NULL THEN least(v, 100) END AS pml, round(CASE WHEN b > 0.5 AND v >= 1 THEN least(b + 0.1, 1) WHEN b > 0.5 AND v > 0 THEN greatest(b - 0.2, 0.1) ELSE b END, 4) AS pml_confidence FROM (SELECT doc_id, coalesce(nullif(p, 0), near, p) AS v, CASE WHEN p > 100 THEN 0.3 WHEN p <> 0 THEN 0.9 WHEN near IS NOT NULL THEN 0.7 WHEN p = 0 THEN 0.9 ELSE 0 END::DOUBLE AS b FROM pml_parts)",
    "x14_deductions": f"SELECT doc_id, {_n('deduction')} AS deduction, CASE WHEN {_n('deduction')} IS NULL THEN 0 WHEN {_n('deduction')} <= 50 THEN 0.9 WHEN {_n('deduction')} <= 100 THEN 0.7 ELSE 0.8 END::DOUBLE AS deduction_confidence FROM slips",
    "x15_claims": f"SELECT doc_id, {_f('claims')} AS claims, CASE WHEN {_f('claims')} IS NULL THEN 0 WHEN regexp_matches({_f('claims')}, '(?i)nil|no claims') THEN 0.9 ELSE 0.8 END::DOUBLE AS claims_confidence FROM slips",
    "x16_share": f"SELECT doc_id, CASE WHEN v IS NOT NULL THEN least(v, 100) END AS share, CASE WHEN v IS NULL THEN 0 WHEN v > 100 THEN 0.3 WHEN v >= 1 THEN 1 ELSE 0.7 END::DOUBLE AS share_confidence FROM (SELECT doc_id, CASE WHEN x > 0 AND x < 1 THEN x * 100 ELSE x END AS v FROM (SELECT doc_id, {_n('share')} AS x FROM slips))",
    "x22_labels": f"SELECT doc_id, {_f('insured')} AS insured, {_n('sum_insured')} AS sum_insured, {_n('retention')} AS retention, {_f('perils')} AS perils, {_f('situation')} AS situation FROM slips",
    "x23_largest_amount": f"""
    SELECT doc_id, largest, nullif(regexp_extract(substr(text, greatest(1, instr(text, given) - 80), least(instr(text, given) - 1, 80) + length(given) + 80), '\\b(USD|EUR|GBP|KES)\\b', 1), '') AS largest_currency
    FROM (SELECT *, nums[list_position(vals, largest)] AS given FROM (SELECT *, list_max(list_filter(vals, lambda v: v > 1000)) AS largest FROM (SELECT *, list_transform(nums, lambda g: try_cast(replace(g, ',', '') AS DOUBLE)) AS vals FROM (SELECT doc_id, text, regexp_extract_all(text, $p${extract.NUMBER}$p$) AS nums FROM slips))))""",
    "x25_slip_indicators": "SELECT doc_id, " + ", ".join(f"n_{n}" for n in extract.SLIP_PATTERNS) + ", len(prim) AS n_primary, len(sec) AS n_secondary FROM slip_found",
    "x26_slip_confidence": "SELECT doc_id, confidence FROM slip_scored",
    "x27_slip_type": "SELECT doc_id, kind FROM slip_scored",
    "x28_slip_quality": f"SELECT doc_id, quality, {_join('issues')}, confidence >= 0.3 AND quality >= 0.5 AND len(issues) <= 3 AS valid FROM slip_scored",
    "x29_slip_priority": "SELECT doc_id, confidence >= 0.3 AS is_slip, CASE WHEN confidence < 0.3 THEN 4 WHEN confidence >= 0.7 AND quality >= 0.6 THEN 1 WHEN confidence >= 0.5 THEN 2 ELSE 3 END AS priority, array_to_string(list_filter([CASE WHEN len(prim) > 0 THEN 'Primary RI keywords found: ' || array_to_string(prim[1:3], ', ') END, CASE WHEN n_matched > 0 THEN 'RI patterns detected: ' || n_matched || ' types' END, CASE WHEN fmt IN ('pdf', 'docx') THEN 'Primary document format: ' || fmt END], lambda x: x IS NOT NULL), '; ') AS reasons FROM (SELECT *, " + " + ".join(f"CASE WHEN n_{n} > 0 THEN 1 ELSE 0 END" for n in extract.SLIP_PATTERNS) + " AS n_matched FROM slip_scored)",
    "x30_format": "SELECT doc_id, fmt AS format, " + S.first_class("lower(text || chr(10) || filename)", extract.DOCUMENT_TYPES, "supporting_document") + " AS type FROM slip_found",
    "x35_migration": f"SELECT doc_id, coalesce({_f('insured')}, {_f('broker')}) AS insured_name, coalesce({_n('sum_insured')}, {_n('premium')}) AS total_sums_insured FROM slips",
    "j14_keyword_hits": f"SELECT doc_id, array_to_string({S.hits(_l, extract.SECONDARY)}, '|') AS hits FROM slips",
    "s13_recovered_json": f"SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN regexp_extract(text, $p${P['insured']}$p$, 1) END AS insured, CASE WHEN doc_id % 3 < 2 THEN {_n('sum_insured')} END AS tsi FROM slips",
    "f10_mail_screen": "SELECT message_id, turn, (contains(sender, '@broker.') OR contains(sender, '@cedant.')) AND (regexp_matches(lower(subject), 'facultative.*reinsurance') OR regexp_matches(lower(subject), 'fac .*placement')) AND regexp_matches(lower(attachment), '(slip|survey).*[.](pdf|docx|xlsx)$') AS accepted FROM messages",
    "a32_assembled": "SELECT message_id, (9 + length(min(subject)) + 1 + 6 + length(min(sender)) + 1 + sum(coalesce(length(text), 0)) + count(text) - 1 + 1 + sum(13 + length(place::VARCHAR) + length(attachment)) + count(*) - 1)::INT AS n, count(*)::INT AS attachments FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY turn) AS place FROM messages) GROUP BY 1",
    "x20_extraction_confidence": "SELECT doc_id, round(" + " + ".join(f"CASE WHEN {f} IS NOT NULL THEN {w} ELSE 0 END" for f, w in extract.EXTRACT_WEIGHTS.items()) + ", 4)::DOUBLE AS extraction_confidence, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in extract.EXTRACT_WEIGHTS) + "], lambda x: x IS NOT NULL), '|') AS missing_fields FROM slip_fields",
    "w1_processing_plan": "SELECT application_id, doc_id, place FROM slip_plan",
    "x31_plan_summary": "SELECT application_id, documents, slips, seconds, CASE WHEN slips = 0 THEN 'No slip found: review by hand' WHEN slips > 1 THEN 'Several slips: process the first by plan' WHEN best < 0.5 THEN 'Slip of low quality: check the fields' ELSE 'Process as planned' END AS advice FROM (SELECT application_id, count(*) AS documents, count(*) FILTER (is_slip) AS slips, sum(" + S.lookup("fmt", extract.SECONDS, None) + ")::BIGINT AS seconds, max(quality) AS best FROM slip_plan GROUP BY 1)",
    "x32_mail_extraction": "SELECT application_id, " + ", ".join(f"arg_min({f}, place) FILTER ({f} IS NOT NULL) AS {f}" for f in ("insured", "cedant", "broker", "sum_insured", "premium")) + " FROM slip_plan JOIN slip_fields USING (doc_id) GROUP BY 1",
    "x33_section_scores": f"SELECT doc_id, place, round(least(0.6, len({S.hits('lower(section)', SECTION_WORDS)}) * 0.2) + CASE WHEN regexp_matches(section, '[0-9]') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(section, $p${P['date']}$p$) THEN 0.2 ELSE 0 END, 4)::DOUBLE AS score FROM (SELECT doc_id, unnest(list_zip(parts, range(0, len(parts)))) AS z, z[1] AS section, z[2]::INT AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))",
    "x34_truncation": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT *, string_split(substr(t, 601, length(t) - 1000), chr(10)) AS middle FROM d WHERE length(t) > 2000),
        s AS (SELECT *, list_sort(list_transform(range(0, len(middle)), lambda i: {{'score': -len({S.hits('lower(middle[i + 1])', BEST_WORDS)}), 'i': i, 's': middle[i + 1]}})) AS scored FROM m),
        f AS (SELECT *, list_reduce(list_prepend({{'room': 1000, 'kept': list_filter([{{'i': 0::BIGINT, 's': ''}}], lambda x: false)}}, list_transform(scored, lambda x: {{'room': length(x.s)::INTEGER, 'kept': [{{'i': x.i, 's': x.s}}]}})), lambda a, x: CASE WHEN x.room <= a.room THEN {{'room': a.room - x.room, 'kept': list_concat(a.kept, x.kept)}} ELSE a END).kept AS kept FROM s),
        u AS (SELECT doc_id, substr(t, 1, 600) || chr(10) || array_to_string(list_transform(list_sort(kept), lambda x: x.s), chr(10)) || chr(10) || substr(t, length(t) - 399, 400) AS v FROM f UNION ALL SELECT doc_id, t FROM d WHERE length(t) <= 2000)
        SELECT doc_id, length(v)::INTEGER AS n, sha256(v) AS truncated_sha256 FROM u""",
    "x36_linearised": "SELECT doc_id, '[TABLE]' || chr(10) || string_agg(line, chr(10) ORDER BY s_suppkey) AS text FROM (SELECT s_nationkey AS doc_id, s_suppkey, s_name || ' | ' || s_suppkey AS line, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier) WHERE place <= 100 GROUP BY 1",
    "x37_entity_fields": f"SELECT doc_id, named[1] AS insured, named[2] AS broker, named[3] AS location, nullif(premium, '') AS sum_insured, NULL::VARCHAR AS premium FROM (SELECT doc_id, regexp_extract(text, $p${P['premium']}$p$, 1) AS premium, list_filter([regexp_extract(text, $p${P['insured']}$p$, 1), CASE WHEN doc_id % 10 / 10 > 0.5 THEN regexp_extract(text, $p${P['location']}$p$, 1) END], lambda x: x <> '') AS named FROM slips)",
    "j16_attachment_refs": "SELECT doc_id, array_to_string(list_sort(list_filter([filename, 'survey_report.pdf'], lambda n: contains(lower(text), lower(n)))), '|') AS mentioned FROM slips",
    "a31_region_rollup": "SELECT message_id AS doc_id, (sum(coalesce(length(text), 0)) + count(text) - 1)::INT AS n, round(avg((coalesce(length(text), 0) % 100) / 100.0), 4)::DOUBLE AS confidence, count(*) AS regions, count(DISTINCT turn) AS pages FROM messages WHERE length(text) % 100 / 100.0 >= 0.2 GROUP BY 1",
}
ORACLE_SQL = {k: oracle(v) for k, v in ORACLE.items()}
