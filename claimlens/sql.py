"""DuckDB SQL of the derived claims, for oracle queries."""


def u(tag: str, key: str = "id", seed: int = 42) -> str:
    return f"('0x' || substr(sha256('{seed}:' || {key} || ':{tag}'), 1, 8))::BIGINT"


def small(tag: str, n: int) -> str:
    return f"({u(tag)} % {n})"


DELTA = "CASE WHEN {small} THEN greatest(100, least(8000, (amount * 3 + 50) // 100)) ELSE greatest(15000, (amount * 12 + 50) // 100) END"

CLAIMS = f"""
WITH shares(label, pos, w) AS (VALUES ('none', 0, 30), ('amount_mismatch', 1, 12), ('over_reimbursement', 2, 8), ('date_mismatch', 3, 8),
  ('merchant_mismatch', 4, 8), ('applicant_mismatch', 5, 8), ('order_id_mismatch', 6, 8), ('missing_document', 7, 8), ('duplicate_in_batch', 8, 5),
  ('unreadable_image', 9, 5)),
total AS (SELECT count(*) AS n FROM orders),
q0 AS (SELECT label, pos, w, n, n * w // 100 AS base, n * w % 100 AS frac FROM shares, total),
q1 AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, w DESC, pos) <= n - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q0),
quotas AS (SELECT label, pos, quota, sum(quota) OVER (ORDER BY pos) AS hi, sum(quota) OVER (ORDER BY pos) - quota AS lo FROM q1),
sup AS (SELECT count(*) AS n, min(s_suppkey) AS first FROM supplier),
b0 AS (
  SELECT o_orderkey AS id, 'MV_ORD_' || lpad(o_orderkey::VARCHAR, 9, '0') AS case_id, c_name, s_name, n_name, o_orderpriority AS expense_type,
    (round(o_totalprice::DECIMAL(20, 6), 2) * 100)::BIGINT AS amount, o_orderdate::DATE AS order_date
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey, sup
  LEFT JOIN supplier ON s_suppkey = sup.first + {u('supplier', 'o_orderkey')} % sup.n LEFT JOIN nation ON s_nationkey = n_nationkey
), b1 AS (SELECT *, order_date + ({small('payment', 4)})::INT AS payment_date FROM b0
), b2 AS (
  SELECT *, payment_date + ({small('invoice', 6)})::INT AS invoice_date, payment_date + ({small('invoice', 6)})::INT + ({small('application', 15)})::INT AS application_date,
    strftime(order_date, '%Y%m%d') || lpad((id % 1000000)::VARCHAR, 6, '0') AS tail,
    row_number() OVER (ORDER BY sha256('342:' || case_id), case_id) AS label_rank
  FROM b1
), labelled AS (SELECT b2.*, label FROM b2 JOIN quotas ON label_rank > lo AND label_rank <= hi
), injected AS (
  SELECT id, case_id, label, label_rank, expense_type, amount AS invoice_amount, amount AS payment_amount, (amount * 6 + 50) // 100 AS tax_amount,
    CASE WHEN label = 'amount_mismatch' THEN amount + {DELTA.format(small=small('small', 100) + ' < 45')} ELSE amount END AS order_amount,
    CASE WHEN label = 'over_reimbursement' THEN amount + {DELTA.format(small=small('small', 100) + ' < 35')} ELSE amount END AS reimbursement_amount,
    order_date, payment_date,
    CASE WHEN label = 'date_mismatch' AND {small('date', 3)} = 0 THEN payment_date - (1 + {small('days', 5)})::INT ELSE application_date END AS application_date,
    CASE WHEN label = 'date_mismatch' AND {small('date', 3)} = 1 THEN payment_date + (91 + {small('days', 50)})::INT
         WHEN label = 'date_mismatch' AND {small('date', 3)} = 2 THEN order_date - (31 + {small('days', 40)})::INT ELSE invoice_date END AS invoice_date,
    c_name AS applicant, s_name AS merchant, s_name AS invoice_merchant, s_name AS order_merchant, [s_name || ' ' || n_name] AS aliases,
    CASE WHEN label = 'merchant_mismatch' THEN 'Outside Vendor ' || lpad(({small('vendor', 10000)})::VARCHAR, 4, '0') ELSE s_name END AS payment_merchant,
    CASE WHEN label = 'applicant_mismatch' AND {small('person', 2)} = 0 THEN 'Other Person' ELSE c_name END AS payer,
    CASE WHEN label = 'applicant_mismatch' AND {small('person', 2)} = 1 THEN 'Other Person' ELSE c_name END AS order_user,
    'INV' || tail AS invoice_id, 'ORD' || tail AS order_id, 'PAY' || tail AS payment_id,
    CASE WHEN label = 'order_id_mismatch' THEN substr('ORD' || tail, 1, length(tail) + 2) || ((right(tail, 1)::INT + 1 + {small('digit', 8)}) % 10)::VARCHAR ELSE 'ORD' || tail END AS shown_order_id,
    CASE WHEN label = 'missing_document' THEN list_filter(['invoice', 'payment', 'reimbursement_form', 'order'], lambda d, i: i - 1 <> {small('document', 4)})
         ELSE ['invoice', 'payment', 'reimbursement_form', 'order'] END AS documents,
    CASE WHEN label = 'none' THEN []::VARCHAR[] ELSE [label] END AS anomaly_types,
    NOT (label = 'missing_document' OR label = 'unreadable_image' AND {small('core', 10)} < 7) AS evidence_sufficient,
    CASE WHEN label = 'unreadable_image' AND {small('core', 10)} < 7 THEN CASE {small('pair', 3)} WHEN 0 THEN ['invoice_amount', 'invoice_merchant']
           WHEN 1 THEN ['payment_amount', 'payment_merchant'] ELSE ['order_amount', 'order_id'] END
         WHEN label = 'unreadable_image' THEN ['expense_type'] ELSE []::VARCHAR[] END AS unreadable_fields,
    CASE WHEN label = 'duplicate_in_batch' THEN CASE WHEN {small('twin', 2)} = 0 THEN 'invoice' ELSE 'order' END END AS duplicate_document
  FROM labelled
), facts AS (
  SELECT *, greatest(invoice_amount, payment_amount, reimbursement_amount, order_amount) - least(invoice_amount, payment_amount, reimbursement_amount, order_amount) AS spread,
    greatest(coalesce(list_min(list_filter([invoice_amount, payment_amount, reimbursement_amount, order_amount], lambda x: x > 0)), 100), 100) AS least_positive,
    reimbursement_amount - least(invoice_amount, payment_amount) AS over, greatest(least(invoice_amount, payment_amount), 100) AS paid,
    label = 'over_reimbursement' OR reimbursement_amount > least(invoice_amount, payment_amount) AS is_over
  FROM injected
), reasoned AS (
  SELECT *, list_filter([
    CASE WHEN NOT list_contains(documents, 'order') THEN 'medium:missing_order_document' END,
    CASE WHEN NOT list_has_all(documents, ['invoice', 'payment', 'reimbursement_form']) THEN 'high:missing_core_document' END,
    CASE WHEN is_over THEN CASE WHEN over <= 10000 AND over * 100 <= paid * 5 THEN 'medium' ELSE 'high' END || ':over_reimbursement' END,
    CASE WHEN NOT is_over AND (label = 'amount_mismatch' OR spread > 0)
      THEN CASE WHEN spread <= 10000 AND spread * 100 <= least_positive * 5 THEN 'medium' ELSE 'high' END || ':amount_mismatch' END,
    CASE WHEN label = 'date_mismatch' AND abs(invoice_date - payment_date) > 90 THEN 'medium:date_mismatch' END,
    CASE WHEN label = 'date_mismatch' AND order_date - invoice_date > 30 THEN 'medium:date_mismatch' END,
    CASE WHEN label = 'date_mismatch' AND application_date < payment_date THEN 'high:date_mismatch' END,
    CASE WHEN label = 'merchant_mismatch' OR NOT list_has_all(list_append(aliases, merchant), [invoice_merchant, payment_merchant, order_merchant]) THEN 'high:merchant_mismatch' END,
    CASE WHEN label = 'applicant_mismatch' OR NOT (applicant = payer AND payer = order_user) THEN 'high:applicant_mismatch' END,
    CASE WHEN label = 'order_id_mismatch' THEN 'high:order_id_mismatch' END,
    CASE WHEN label = 'duplicate_in_batch' THEN 'high:duplicate_in_batch' END,
    CASE WHEN label = 'unreadable_image' THEN CASE WHEN unreadable_fields <> ['expense_type'] THEN 'high' ELSE 'medium' END || ':unreadable_image' END
  ], lambda x: x IS NOT NULL) AS reasons FROM facts
), risked AS (
  SELECT *, CASE WHEN len(anomaly_types) = 0 AND len(documents) = 4 THEN 'low'
    WHEN list_bool_or(list_transform(reasons, lambda r: starts_with(r, 'high:'))) THEN 'high'
    WHEN list_bool_or(list_transform(reasons, lambda r: starts_with(r, 'medium:'))) THEN 'medium' ELSE 'low' END AS risk_level FROM reasoned
), claims AS (
  SELECT *, CASE WHEN len(documents) < 4 THEN 'missing_info' WHEN risk_level = 'high' AND evidence_sufficient THEN 'reject_recommendation'
    WHEN risk_level IN ('high', 'medium') THEN 'manual_review' ELSE 'pass' END AS audit_result FROM risked
)
"""

SPLITS = f"""{CLAIMS}, sw(split, pos, w) AS (VALUES ('train', 0, 30000), ('val_in_template', 1, 2000), ('val_unseen_template', 2, 1000), ('test_clean', 3, 2000),
  ('test_robust', 4, 2000), ('test_unseen_template', 5, 2000), ('test_hard_negative', 6, 2000)),
s0 AS (SELECT split, pos, w, n * w // 41000 AS base, n * w % 41000 AS frac, n FROM sw, total),
s1 AS (SELECT split, pos, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, w DESC, pos) <= n - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM s0),
able AS (SELECT *, label IN ('amount_mismatch', 'merchant_mismatch', 'applicant_mismatch', 'order_id_mismatch') AS able FROM claims),
r1 AS (SELECT *, able AND row_number() OVER (PARTITION BY able ORDER BY sha256('343:' || case_id), case_id) <= (SELECT quota FROM s1 WHERE split = 'test_hard_negative') AS hard FROM able),
r2 AS (SELECT *, row_number() OVER (PARTITION BY hard ORDER BY sha256('343:' || case_id), case_id) AS r FROM r1),
ranges AS (
  SELECT split, sum(quota) OVER (ORDER BY pos) AS hi, sum(quota) OVER (ORDER BY pos) - quota AS lo
  FROM (SELECT split, CASE WHEN split = 'test_hard_negative' THEN -1 ELSE pos END AS pos,
          CASE WHEN split = 'test_hard_negative' THEN greatest(quota - (SELECT count(*) FROM able WHERE able), 0) ELSE quota END AS quota FROM s1)
), splits AS (
  SELECT r2.*, 'test_hard_negative' AS split FROM r2 WHERE hard
  UNION ALL SELECT r2.*, split FROM r2 JOIN ranges ON NOT hard AND r > lo AND r <= hi
)
"""
