"""Registered queries: scalar functions and row-to-text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import textrow
from ..operators import labels, tickets
from .registry import Tables, query
from .standins import R, rnd


@query("sc1_sc2_json_paths", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS valid, CASE WHEN event_id % 11 <> 0 THEN CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) AS BIGINT) END AS k,
  CAST(NULL AS VARCHAR) AS missing FROM events""")
def sc1(t: Tables):
    p = t.events.withColumn("p", F.when(F.col("event_id") % 11 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props")))
    return p.select("event_id", sc.json_valid("p").cast("int").alias("valid"), sc.json_number("p", "k").cast("long").alias("k"), sc.json_text("p", "a.b").alias("missing"))


@query("sc3_sc4_amounts_and_codes", f"""SELECT event_id, {R("CASE WHEN event_type = 'view' THEN value * 2 ELSE value END / 100.0", 4)} AS amount, right(trim(props), 4) AS tail, left(trim(props), 3) AS head FROM events""")
def sc3(t: Tables):
    minor = F.when(F.col("event_type") == "view", F.col("value") * 2).otherwise(F.col("value"))
    return t.events.select("event_id", rnd(minor / 100.0, 4).alias("amount"), sc.tail_code("props", 4).alias("tail"), sc.head_code("props", 3).alias("head"))


@query("sc5_sc6_regex", r"""SELECT doc_id, nullif(regexp_extract(text, '[0-9]{4,}'), '') AS first_number, length(regexp_replace(text, '[\s,"\]]', '', 'g')) AS stripped_length FROM documents""")
def sc5(t: Tables):
    return t.documents.select("doc_id", sc.first_match("text", "[0-9]{4,}").alias("first_number"), F.length(F.regexp_replace("text", tickets.REFERENCE_NOISE, "")).alias("stripped_length"))


@query("sc7_type_roll_up", "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'browse' WHEN event_type = 'purchase' THEN 'buy' ELSE event_type END AS mapped, count(*) AS n FROM events GROUP BY 1 HAVING mapped IN ('browse', 'buy', 'error')")
def sc7(t: Tables):
    m = tickets.roll_up("event_type", {"view": "browse", "click": "browse", "purchase": "buy"})
    return t.events.select(m.alias("mapped")).where(F.col("mapped").isin("browse", "buy", "error")).groupBy("mapped").agg(F.count(F.lit(1)).alias("n"))


@query("sc8_dates_and_abs", f"SELECT year(o_orderdate) AS y, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, {R('sum(abs(o_totalprice - 250000))', 2)} AS distance FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1, 2")
def sc8(t: Tables):
    o = t.orders.where(F.to_date("o_orderdate").between("1996-01-01", "1998-12-31"))
    return o.groupBy(F.year("o_orderdate").alias("y"), F.trunc("o_orderdate", "quarter").alias("q")).agg(rnd(F.sum(F.abs(F.col("o_totalprice") - 250000)), 2).alias("distance"))


@query("sc9_sc10_whole_days", """SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000) AS INT) AS days_left, ts + INTERVAL 90 DAY AS window_end FROM events""")
def sc9(t: Tables):
    end = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    return t.events.select("event_id", labels.whole_days(end, "ts").alias("days_left"), labels.window_end("ts").alias("window_end"))


@query("sc11_sc12_ages", f"""SELECT key, {R('d / 30.436875', 6)} AS months, CASE WHEN round_even(d / 365.2425, 0) BETWEEN 2 AND 4 THEN {R('d / 365.2425', 6)} END AS years, CASE WHEN a / 365.2425 >= 18 - 0.5 THEN 1 ELSE 0 END AS adult
FROM (SELECT l_orderkey * 10 + l_linenumber AS key, datediff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS d, datediff('day', CAST(o_orderdate AS DATE), DATE '2016-06-01') AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def sc11(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    at = F.lit("2001-12-31")
    years = sc.years_between_dates(at, "o_orderdate")
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), rnd(sc.months_between_dates(at, "o_orderdate"), 6).alias("months"),
                    F.when(F.bround(years, 0).between(2, 4), rnd(years, 6)).alias("years"), sc.guarded_age(F.lit("2016-06-01"), "o_orderdate").isNotNull().cast("int").alias("adult"))


@query("sc12_expiry_guard", f"SELECT o_orderkey, CASE WHEN d >= 0 AND round_even(d / 365.2425, 0) <= 10 THEN {R('d / 365.2425', 6)} END AS years_to_expiry FROM (SELECT o_orderkey, datediff('day', DATE '1988-06-01', CAST(o_orderdate AS DATE) - 3 * 365) AS d FROM orders)")
def sc12(t: Tables):
    return t.orders.select("o_orderkey", rnd(sc.guarded_expiry(F.date_sub(F.to_date("o_orderdate"), 3 * 365), F.lit("1988-06-01")), 6).alias("years_to_expiry"))


@query("sc13_happened_before", "SELECT l_linestatus, CAST(sum(CASE WHEN d < o_orderdate + INTERVAL 30 DAY THEN 1 ELSE 0 END) AS BIGINT) AS before, count(*) AS n FROM (SELECT *, CASE WHEN l_linenumber <> 2 THEN l_shipdate END AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1")
def sc13(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    d, ts = F.when(F.col("l_linenumber") != 2, F.col("l_shipdate")), F.col("o_orderdate") + F.expr("interval 30 days")
    return j.groupBy("l_linestatus").agg(F.sum(sc.happened_before(d, ts)).alias("before"), F.count(F.lit(1)).alias("n"))


@query("sc14_fill_lower_strip", "SELECT lower(trim(coalesce(CASE WHEN doc_id % 4 <> 0 THEN ' ' || upper(source) || ' ' END, 'Unattributed'))) AS channel, count(*) AS n FROM documents GROUP BY 1")
def sc14(t: Tables):
    x = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit(" "), F.upper("source"), F.lit(" ")))
    return t.documents.groupBy(sc.clean_lower(x, "Unattributed").alias("channel")).agg(F.count(F.lit(1)).alias("n"))


MAILS = ["gmail.com", "x#yahoo.com", "corp.example", "live.co.uk", "a@b@outlook.com"]
MAIL_SQL = "CASE CAST(doc_id % 5 AS INT) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MAILS)) + " END"


@query("sc15_mail_features", f"""SELECT doc_id, CASE WHEN regexp_matches(e, '[0-9]') THEN 1 ELSE 0 END AS has_digit, CASE WHEN d IN ('gmail.com','hotmail.com','outlook.com','yahoo.com','hotmail.co.uk','icloud.com','yahoo.co.uk','live.co.uk') THEN d ELSE 'other' END AS domain
FROM (SELECT doc_id, e, split_part(split_part(e, '@', -1), '#', -1) AS d FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END || '@' || {MAIL_SQL} AS e FROM documents))""")
def sc15(t: Tables):
    host = F.get(F.array(*[F.lit(m) for m in MAILS]), (F.col("doc_id") % 5).cast("int"))
    e = F.concat(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.col("lang")), F.lit("@"), host)
    return t.documents.select("doc_id", sc.has_digit(e).alias("has_digit"), sc.mail_domain(e).alias("domain"))


@query("sc16_company_type", "SELECT CASE WHEN x IS NULL OR x IN ('NONE', 'None', '', 'nan') THEN 'SOLE-TRADER' WHEN upper(x) = 'LTD' THEN 'LTD' ELSE 'other' END AS bucket, count(*) AS n FROM (SELECT CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'Ltd' WHEN 1 THEN 'None' WHEN 2 THEN c_mktsegment WHEN 3 THEN '' END AS x FROM customer) GROUP BY 1")
def sc16(t: Tables):
    k = F.col("c_custkey") % 5
    x = F.when(k == 0, "Ltd").when(k == 1, "None").when(k == 2, F.col("c_mktsegment")).when(k == 3, "")
    return t.customer.groupBy(sc.company_type_bucket(x).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("sc17_outward_letters", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'SW' WHEN c_custkey % 4 = 2 THEN 'ECA' ELSE 'B' END AS area FROM customer""")
def sc17(t: Tables):
    k, n = F.col("c_custkey") % 4, (F.col("c_custkey") % 9).cast("string")
    code = F.when(k == 0, F.concat(F.lit("Error "), n)).when(k == 1, F.concat(F.lit("sw"), n, F.lit(" 1ab"))).when(k == 2, F.concat(F.lit("ec"), n, F.lit("a"))).otherwise(F.concat(F.lit("b"), n, n, F.lit(" "), n, F.lit("qx")))
    return t.customer.select("c_custkey", sc.outward_letters(code).alias("area"))


@query("sc18_country_names", "SELECT c_custkey, n_name AS country FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 6 = 0 THEN -1 ELSE c_nationkey END")
def sc18(t: Tables):
    d = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 6 == 0, -1).otherwise(F.col("c_nationkey")).alias("code"))
    return sc.with_dimension(d, "code", t.nation, "n_nationkey", "n_name", "country").drop("code")


@query("sc19_id_type_mapping", "SELECT l_orderkey * 10 + l_linenumber AS key, CASE WHEN l_returnflag <> 'N' THEN lower(l_returnflag) || '-' || lower(l_linestatus) END AS id_type FROM lineitem")
def sc19(t: Tables):
    mapping = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_returnflag").alias("rf"), F.concat(F.lit(" "), F.col("l_linestatus")).alias("ls")).distinct()
    mapping = mapping.select(F.lower("rf").alias("l_returnflag"), F.lower("ls").alias("l_linestatus"), F.concat_ws("-", F.lower("rf"), F.trim(F.lower("ls"))).alias("v"))
    d = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_returnflag", "l_linestatus")
    return sc.with_mapped_type(d, ["l_returnflag", "l_linestatus"], mapping, "v", "id_type").select("key", "id_type")


@query("sc20_spelling_variants", "SELECT CASE WHEN lower(p_type) = 'economy' THEN 'eco' ELSE lower(p_type) END AS kind, count(*) AS n FROM part GROUP BY 1")
def sc20(t: Tables):
    from ..operators.payment import tidy_text

    return t.part.groupBy(tidy_text("p_type", {"economy": "eco"}).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("sc21_sc22_industry_codes", """SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(5, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') AS sic_0, CASE WHEN p_partkey % 3 = 0 THEN lpad(CAST(p_size AS VARCHAR), 5, '0') WHEN p_partkey % 3 = 1 THEN '1234567' END AS sic_1, CAST(NULL AS VARCHAR) AS sic_2 FROM part""")
def sc21(t: Tables):
    k = F.col("p_partkey")
    text = F.concat_ws(",", k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".0"))).when(k % 3 == 1, F.lit("1234567")).otherwise("unknown"))
    return t.part.select("p_partkey", *sc.numbered(sc.industry_codes(text), "sic", 3))


@query("sc23_known_values", """SELECT c_custkey, string_agg(v, ',' ORDER BY v) AS vals FROM (SELECT DISTINCT c_custkey, unnest([CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'GB', CASE WHEN c_custkey % 3 = 0 THEN 'GB' ELSE 'FR' END]) AS v FROM customer) WHERE v IS NOT NULL GROUP BY 1""")
def sc23(t: Tables):
    a = F.array(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.lit("UNKNOWN"))
    b = F.array(F.lit("GB"), F.when(F.col("c_custkey") % 3 == 0, "GB").otherwise("FR"))
    return t.customer.select("c_custkey", F.array_join(sc.known_values([a, b]), ",").alias("vals"))


@query("sc24_sc26_lists_and_buckets", """SELECT page_id, CAST(n AS INT) AS n_parts, CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n >= 3 THEN '3+' END AS bucket FROM (
  SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 0 ELSE len(string_split(url, '&')) END AS n FROM pages)""")
def sc24(t: Tables):
    parts = sc.split_list(F.when(F.col("page_id") % 5 != 0, F.col("url")), "&")
    return t.pages.select("page_id", F.size(parts).alias("n_parts"), sc.count_bucket(F.size(parts)).alias("bucket"))


@query("sc25_json_level", "SELECT c_custkey, CASE CAST(c_nationkey % 5 AS INT) WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3+' WHEN 4 THEN '3+' END AS level_bucket FROM customer")
def sc25(t: Tables):
    doc = F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit('{"1": '), (F.col("c_nationkey") % 5).cast("string"), F.lit(', "2": 9}'))).otherwise("{}")
    return t.customer.select("c_custkey", sc.json_level_bucket(doc).alias("level_bucket"))


@query("sc27_director_nationality", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS nationality FROM customer")
def sc27(t: Tables):
    tree = F.to_json(F.array(
        F.struct(F.lit("Ann").alias("firstname"), F.lit("Lee").alias("lastname"), F.lit("1980-01-01").alias("dob"), F.lit("XX").alias("nationality")),
        F.struct(F.upper("c_name").alias("firstname"), F.lit(" Lee ").alias("lastname"), F.lit("1990-05-05").alias("dob"), F.col("c_mktsegment").alias("nationality"))))
    born = F.when(F.col("c_custkey") % 2 == 0, "1990-05-05").otherwise("1991-05-05")
    return t.customer.select("c_custkey", F.array_join(sc.director_nationalities(tree, "c_name", F.lit("lee"), born), ",").alias("nationality"))


KEYWORDS = ["the", "une", "los", "anatwith"]


@query("sc28_keywords", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])(the|une|los|anatwith)([^\p{L}\p{N}]|$)') THEN 1 ELSE 0 END AS has_keyword FROM documents""")
def sc28(t: Tables):
    return t.documents.select("doc_id", sc.has_keyword("text", KEYWORDS).alias("has_keyword"))


@query("sc29_clean_text", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text, 'The ', ''), '[^a-zA-Z0-9 \n.]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""")
def sc29(t: Tables):
    return t.documents.select("doc_id", F.md5(sc.clean_text("text", "The ")).alias("digest"))


@query("sc30_fill_defaults", f"SELECT c_mktsegment, {R('avg(coalesce(nullif(c_nationkey, 3), 0))', 6)} AS a, count(DISTINCT coalesce(CASE WHEN c_nationkey > 4 THEN c_nationkey END, 99)) AS b FROM customer GROUP BY 1")
def sc30(t: Tables):
    d = t.customer.select("c_mktsegment", F.nullif("c_nationkey", F.lit(3)).alias("a"), F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("b")).fillna({"a": 0, "b": 99})
    return d.groupBy("c_mktsegment").agg(rnd(F.avg("a"), 6).alias("a"), F.countDistinct("b").alias("b"))


K = "c_custkey"
MEMBER_INPUT = {
    "company_is_registered": f"CASE WHEN {K} % 3 = 0 THEN 1 WHEN {K} % 3 = 1 THEN 0 END", "company_type": "c_mktsegment", "company_icc": "c_name",
    "applicant_age_at_completion": f"20 + {K} % 50 + 0.75", "company_age_at_timestamp": f"CASE WHEN {K} % 4 <> 0 THEN {K} % 100 + 0.5 END",
    "is_restricted_keyword_present": f"{K} % 2", "days_to_transact": f"CASE WHEN {K} % 5 <> 0 THEN {K} % 30 END", "applicant_years_to_id_expiry": f"CASE WHEN {K} % 6 <> 0 THEN {K} % 9 + 0.4 END",
    "is_ftt": f"{K} % 2", "days_to_approval": f"{K} % 7", "days_on_books": f"{K} % 300", "days_remaining_as_ntt_ftt": f"365 - {K} % 300",
    "applicant_email_numeric": f"({K} + 1) % 2", "applicant_email_domain": f"CASE WHEN {K} % 3 = 0 THEN 'other' ELSE 'gmail.com' END", "applicant_device_type": "'ios'",
    "applicant_id_type": "'Passport'", "applicant_idcountry_issue": "'Ireland'", "applicant_postcode": "'SW'", "fastpmt_beneficiaries": f"{K} % 11", "fastpmt_benefactors": f"{K} % 12",
    "ddebit_beneficiaries": f"{K} % 13", "avg_deposit": "abs(c_acctbal)"}
I = "CAST(trunc({}) AS BIGINT)"


@query("sc31_member_sentence", f"""SELECT c_custkey, 'The member segment is ''' || CASE WHEN is_ftt > 0 THEN 'First Transaction to the platform' ELSE 'New to the platform' END || '''; '
 || CASE WHEN company_is_registered = 1 THEN 'the account is of type ' || company_type || ' and registered with the ' || company_icc || ' industry classification. ' ELSE 'the account is of type ' || company_type || ' and is not registered. ' END
 || 'The age of the applicant at onboarding is ' || {I.format('applicant_age_at_completion')} || ' years, and the age of the business is ' || coalesce({I.format('company_age_at_timestamp')} || ' months. ', 'unknown. ')
 || CASE WHEN is_restricted_keyword_present = 1 THEN 'It has high risk of fraudulent activity due to the presence of restricted keywords in its trading name; ' ELSE 'has low or medium risk of fraudulent activity due to the absence of restricted keywords in its trading name; ' END
 || coalesce('has done its first transaction after ' || {I.format('days_to_transact')} || ' days since approval; ', 'has not done its first transaction till now since approval; ')
 || 'has taken ' || days_to_approval || ' days to get approved after completing the onboarding event; has completed ' || days_on_books || ' days on books since approval; and ' || days_remaining_as_ntt_ftt || ' days are remaining to become a tenured member. '
 || 'The email contains ' || CASE WHEN applicant_email_numeric = 0 THEN 'no' ELSE 'some' END || ' numeric characters with a domain that is ' || CASE WHEN applicant_email_domain = 'other' THEN 'other than standard' ELSE applicant_email_domain END || ' and uses the ios operating system on a mobile device. '
 || 'The proof of identification is a passport issued by the Ireland that is valid for the next ' || coalesce(CAST({I.format('applicant_years_to_id_expiry')} AS VARCHAR), 'unknown') || ' years and has been residing at the SW outward code. '
 || 'The number of fast payment beneficiaries added is ' || fastpmt_beneficiaries || ', the number of fast payment benefactors added is ' || fastpmt_benefactors || ' and, the number of direct debit beneficiaries added is ' || ddebit_beneficiaries || '. '
 || 'The average value of deposits made by the member is ' || {I.format('avg_deposit')} || ' pounds.' AS text
FROM (SELECT c_custkey, {', '.join(f'{e} AS {n}' for n, e in MEMBER_INPUT.items())} FROM customer)""")
def sc31(t: Tables):
    d = t.customer.select("c_custkey", *[F.expr(e).alias(n) for n, e in MEMBER_INPUT.items()])
    return d.select("c_custkey", textrow.member_sentence().alias("text"))


PAY_INPUT = {
    "is_registered": "CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 0 END", "industry_classification": "event_type",
    "number_of_accounts_with_same_payee": "CASE WHEN event_id % 4 <> 0 THEN user_id % 6 END", "requested_payment_value": "value", "hours_since_confirmation_of_payee": "event_id % 48 + 0.5",
    "rolling_max_of_withdrawals_to_counter_party_60d": "value * 3", "number_of_withdrawals_over_threshold_60d": "event_id % 9", "ratio_pmts_outside_business_60d": "event_id % 3 + 0.25",
    "rolling_mean_of_deposits_from_counter_party_60d": "value / 2", "number_of_high_outgoing_fastpayments_on_account_60d": "event_id % 5", "rolling_sum_of_withdrawals_on_account_2h": "value * 2"}


@query("sc32_payment_sentence", f"""SELECT event_id, CASE WHEN is_registered = 1 THEN 'This member account is registered with ' || industry_classification || ' industry classification, ' ELSE 'This member account is not registered, ' END
 || coalesce('has ' || number_of_accounts_with_same_payee || ' platform accounts with the same payee, ', 'has no platform accounts with the same payee, ')
 || 'had done a transaction of ' || {I.format('requested_payment_value')} || ' value in the first ' || {I.format('hours_since_confirmation_of_payee')} || ' hours after payee addition. The maximum of withdrawals done earlier to the payee in the last 60 days is '
 || {I.format('rolling_max_of_withdrawals_to_counter_party_60d')} || '. Also, the overall number of withdrawals over a high threshold in the last 60 days is ' || number_of_withdrawals_over_threshold_60d || '. Ratio of payments outside of the business in the last 60 days is '
 || {I.format('ratio_pmts_outside_business_60d')} || '. The average of deposits done earlier from the payee in the last 60 days is ' || {I.format('rolling_mean_of_deposits_from_counter_party_60d')}
 || '. The number of high outgoing fast payments on the member account in the last 60 days is ' || number_of_high_outgoing_fastpayments_on_account_60d || ' and total sum of withdrawals on the member account in the last 2 hours is ' || {I.format('rolling_sum_of_withdrawals_on_account_2h')} AS text
FROM (SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in PAY_INPUT.items())} FROM events)""")
def sc32(t: Tables):
    d = t.events.select("event_id", *[F.expr(e).alias(n) for n, e in PAY_INPUT.items()])
    return d.select("event_id", textrow.payment_sentence().alias("text"))


@query("sc33_sc34_rounding", f"SELECT row_id, {R('round_even(p * 1000, 2)', 2)} AS score, CAST(round_even(d / 7.0, 0) AS INT) AS weeks FROM (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_discount + l_tax / 7 AS p, datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem)")
def sc33(t: Tables):
    d = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), rnd(sc.scaled_score(F.col("l_discount") + F.col("l_tax") / 7), 2).alias("score"),
                             sc.whole_weeks(d).cast("int").alias("weeks"))


@query("sc35_month_key", "SELECT year(o_orderdate) || '_' || month(o_orderdate) AS month_year, count(*) AS n FROM orders GROUP BY 1")
def sc35(t: Tables):
    return t.orders.groupBy(sc.month_key("o_orderdate").alias("month_year")).agg(F.count(F.lit(1)).alias("n"))


@query("sc36_risk_levels", "SELECT CASE WHEN 1 - p <= 0.05 THEN 'Low' WHEN 1 - p >= 0.08 THEN 'High' ELSE 'Medium' END AS level, CASE WHEN 1 - p <= 0.05 THEN 1 WHEN 1 - p >= 0.08 THEN 3 ELSE 2 END AS number, count(*) AS n FROM (SELECT 1 - (l_discount + 0.0012) AS p FROM lineitem) GROUP BY 1, 2")
def sc36(t: Tables):
    p = 1 - (F.col("l_discount") + 0.0012)
    return t.lineitem.groupBy(sc.risk_level(p, 0.05, 0.08).alias("level"), sc.risk_number(p, 0.05, 0.08).alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("sc37_softmax", f"SELECT row_id, {R('exp(b) / (exp(a) + exp(b))', 6)} AS probability, CAST(b > a AS INT) AS predicted FROM (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity / 25 AS a, l_discount * 20 + 0.01 AS b FROM lineitem)")
def sc37(t: Tables):
    logits = F.array(F.col("l_quantity") / 25, F.col("l_discount") * 20 + 0.01)
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), rnd(sc.softmax_positive(logits), 6).alias("probability"), sc.argmax_class(logits).alias("predicted"))


@query("sc38_record", """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS record FROM customer""")
def sc38(t: Tables):
    return t.customer.select("c_custkey", sc.as_record(["c_custkey", "c_mktsegment"]).alias("record"))


@query("sc39_category_text", "SELECT upper(coalesce(CASE WHEN c_custkey % 3 <> 0 THEN lower(c_mktsegment) END, 'missing')) AS category, count(*) AS n FROM customer GROUP BY 1")
def sc39(t: Tables):
    return t.customer.groupBy(sc.category_text(F.when(F.col("c_custkey") % 3 != 0, F.lower("c_mktsegment"))).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("sc40_word_count", r"""SELECT doc_id, CASE WHEN x = '' THEN 0 ELSE len(regexp_split_to_array(x, '\s+')) END AS words FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS x FROM documents)""")
def sc40(t: Tables):
    return t.documents.select("doc_id", sc.word_count("text").cast("long").alias("words"))
