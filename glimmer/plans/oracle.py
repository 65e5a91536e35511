"""DuckDB SQL for the queries in catalog.py. Without SQL: pca_nmse and semi_nmf_nmse (eigenvectors and a solver),
l1_feature_ranking and tree_feature_ranking (fitted models); tests compare the first two with plain numpy."""

from __future__ import annotations

BASE = """
WITH act AS (SELECT vec_id AS row, vec_id // 4 AS example_idx, vec_id % 4 AS token_idx, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings
), total AS (SELECT count(*) AS n FROM act
), dims AS (SELECT row, unnest(range(0, 64)) AS d, unnest(x) AS v FROM act
), mean AS (SELECT d, avg(v) AS m FROM dims GROUP BY d
), proto AS (SELECT row AS feature, d, v - m AS c FROM dims JOIN mean USING (d) WHERE row < 32
), size AS (SELECT feature, sqrt(sum(c * c)) AS s FROM proto GROUP BY feature
), w AS (SELECT feature::INTEGER AS feature, list(c / s ORDER BY d) AS wv FROM proto JOIN size USING (feature) GROUP BY feature
), h AS (SELECT row, example_idx, token_idx, label, feature, list_inner_product(x, wv) AS h FROM act CROSS JOIN w
), codes AS (SELECT row, example_idx, token_idx, label, feature, h AS value FROM h WHERE h > 0
), features AS (SELECT unnest(range(0, 32))::INTEGER AS feature
), classes AS (SELECT unnest(range(0, 10))::INTEGER AS class
), npos AS (SELECT class, count(label) AS total FROM classes LEFT JOIN act ON label = class GROUP BY class
), stats AS (
  SELECT feature, count(value) AS nnz, coalesce(sum(value), 0) AS sum, CASE WHEN count(value) > 0 THEN sum(value) / count(value) END AS mean_value, count(value) / (SELECT n FROM total)::DOUBLE AS sparsity
  FROM features LEFT JOIN codes USING (feature) GROUP BY feature
)"""

FIXED = """, dense AS (SELECT row, feature, label, greatest(h, 0) AS v FROM h
), cuts AS (SELECT feature, quantile_cont(v, 0.95) AS cut FROM dense GROUP BY feature
), above AS (SELECT row, feature, label FROM codes JOIN cuts USING (feature) WHERE value > cut
)"""

PRF = """, taus AS (SELECT unnest([0.0, 0.1, 0.3])::DOUBLE AS tau
), conf AS (
  SELECT feature, class, tau, count_if(h > tau AND label = class) AS tp, count_if(h > tau AND label <> class) AS fp, count_if(h <= tau AND label = class) AS fn, count_if(h <= tau AND label <> class) AS tn
  FROM h CROSS JOIN classes CROSS JOIN taus GROUP BY feature, class, tau
), prf AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1 FROM conf
)"""

#: Tie-aware average precision of every feature and class, and AUROC, by groups of equal scores.
TIES = """, scores AS (SELECT feature, label, greatest(h, 0) AS v FROM h
), tie AS (SELECT feature, class, v, count(*) AS n, count_if(label = class) AS pos FROM scores CROSS JOIN classes GROUP BY feature, class, v
), placed AS (
  SELECT *, coalesce(sum(n) OVER up, 0) AS t, coalesce(sum(pos) OVER up, 0) AS r0, coalesce(sum(n) OVER down, 0) AS below FROM tie
  WINDOW up AS (PARTITION BY feature, class ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), down AS (PARTITION BY feature, class ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), members AS (SELECT *, unnest(range(t::BIGINT + 1, (t + n)::BIGINT + 1)) AS j FROM placed WHERE pos > 0
), summed AS (SELECT feature, class, sum(pos / n::DOUBLE * (r0 + 1 + CASE WHEN n > 1 THEN (j - t - 1) * (pos - 1) / (n - 1)::DOUBLE ELSE 0 END) / j) AS s FROM members GROUP BY feature, class
), tap AS (SELECT feature, class, CASE WHEN total > 0 THEN coalesce(s, 0) / total ELSE 0 END AS ap, total FROM features CROSS JOIN npos LEFT JOIN summed USING (feature, class)
)"""



def ties(part: str, where: str) -> str:
    """Tables tie_part, placed_part and tap_part over some of the rows."""
    return f""", n_{part} AS (SELECT class, count(label) AS total FROM classes LEFT JOIN act ON label = class AND {where} GROUP BY class
), tie_{part} AS (SELECT feature, class, greatest(h, 0) AS v, count(*) AS n, count_if(label = class) AS pos FROM h CROSS JOIN classes WHERE {where} GROUP BY feature, class, greatest(h, 0)
), placed_{part} AS (
  SELECT *, coalesce(sum(n) OVER up, 0) AS t, coalesce(sum(pos) OVER up, 0) AS r0 FROM tie_{part} WINDOW up AS (PARTITION BY feature, class ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), members_{part} AS (SELECT *, unnest(range(t::BIGINT + 1, (t + n)::BIGINT + 1)) AS j FROM placed_{part} WHERE pos > 0
), summed_{part} AS (SELECT feature, class, sum(pos / n::DOUBLE * (r0 + 1 + CASE WHEN n > 1 THEN (j - t - 1) * (pos - 1) / (n - 1)::DOUBLE ELSE 0 END) / j) AS s FROM members_{part} GROUP BY feature, class
), tap_{part} AS (SELECT feature, class, round(CASE WHEN total > 0 THEN coalesce(s, 0) / total ELSE 0 END, 9) AS ap FROM features CROSS JOIN n_{part} LEFT JOIN summed_{part} USING (feature, class)
)"""


#: One damped Newton step for each feature and class from the prior.
PROBE = """, prior AS (SELECT class, total, total / n::DOUBLE AS mean, ln(greatest(1e-12, least(1 - 1e-12, total / n::DOUBLE)) / (1 - greatest(1e-12, least(1 - 1e-12, total / n::DOUBLE)))) AS b0, n FROM npos, total
), qx AS (SELECT feature, greatest(coalesce(sqrt(avg(value * value)), 1), 1e-6) AS qx, count(value) AS nnz FROM features LEFT JOIN codes USING (feature) GROUP BY feature
), x AS (SELECT feature, class, b0, n, mean, greatest(h, 0) AS x, (label = class)::INTEGER AS y, 1 / (1 + exp(-b0)) AS mu FROM h CROSS JOIN prior
), g AS (
  SELECT feature, class, any_value(b0) AS b0, avg(mu) - any_value(mean) AS g0, sum((mu - y) * x) / any_value(n) AS g1, avg(mu * (1 - mu)) + 1e-8 AS h0, sum(mu * (1 - mu) * x) / any_value(n) AS h1, sum(mu * (1 - mu) * x * x) / any_value(n) + 1e-8 AS h2
  FROM x GROUP BY feature, class
), s0 AS (SELECT *, h0 + 1e-3 AS a, h2 + 1e-3 * qx * qx AS c FROM g JOIN qx USING (feature)
), s1 AS (SELECT *, (c * g0 - h1 * g1) / (a * c - h1 * h1) AS db, (a * g1 - h1 * g0) / (a * c - h1 * h1) AS dw FROM s0
), s2 AS (SELECT *, CASE WHEN sqrt(db * db + qx * qx * dw * dw) > 6 THEN 6 / sqrt(db * db + qx * qx * dw * dw) ELSE 1 END AS k FROM s1
), par AS (SELECT feature, class, CASE WHEN nnz > 0 THEN b0 - k * db ELSE b0 END AS b, CASE WHEN nnz > 0 THEN -k * dw ELSE 0 END AS w FROM s2
), z AS (SELECT h.feature, par.class, b + par.w * greatest(h, 0) AS z, (label = par.class)::INTEGER AS y FROM h JOIN par USING (feature)
), loss AS (SELECT feature, class, avg(greatest(z, 0) + ln(1 + exp(-abs(z))) - y * z) AS loss FROM z GROUP BY feature, class
)"""

#: Nearest of the first eight prototypes.
NEAR = """, dist AS (SELECT row, feature AS center, list_distance(x, wv) AS d FROM act CROSS JOIN w WHERE feature < 8
), near AS (SELECT row, arg_min(center, (round(d, 12), center)) AS center, min(d) AS distance FROM dist GROUP BY row
)"""


def recon(prefixes: str) -> str:
    return f""", pre AS (SELECT unnest([{prefixes}])::INTEGER AS prefix
), part AS (SELECT row, prefix, d, sum(value * c / s) AS v FROM codes JOIN pre ON feature < prefix JOIN proto USING (feature) JOIN size USING (feature) GROUP BY row, prefix, d
), hat AS (SELECT dims.row, pre.prefix, dims.d, dims.v AS x, coalesce(part.v, 0) AS y FROM dims CROSS JOIN pre LEFT JOIN part ON part.row = dims.row AND part.prefix = pre.prefix AND part.d = dims.d
)"""


def on_base(extra: str, select: str) -> str:
    return f"{BASE}{extra} {select}"


def oracle_sql() -> dict[str, str]:
    b = on_base
    stats_row = "feature, nnz, round(sum, 6) AS sum, round(mean_value, 6) AS mean_value, round(sparsity, 6) AS sparsity"
    front = "min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND {}) AS best"
    return {
        "activation_scan_ordered": b("", "SELECT row, example_idx, token_idx, label, round(sqrt(list_inner_product(x, x)), 6) AS size FROM act"),
        "index_map": """SELECT vec_id AS i, vec_id // 4 AS example_idx, vec_id % 4 AS token_idx, vec_id // 4 // 20 AS shard_idx, vec_id // 4 % 20 AS example_in_shard, vec_id % 4 + 1 AS token_in_shard,
            ((vec_id // 4 % 20 * 2 + 1) * 5 + vec_id % 4 + 1) * 256 AS byte_offset FROM embeddings""",
        "shuffled_scan": "SELECT vec_id AS row, label, md5('7:' || vec_id) AS shuffle_key FROM embeddings WHERE label NOT IN (0, 3)",
        "point_lookup": "SELECT vec_id AS row, vec_id // 4 AS example_idx, vec_id % 4 AS token_idx, label FROM embeddings WHERE vec_id IN (0, 17, 123, 499)",
        "whole_batches": "SELECT vec_id // 64 AS batch, count(*) AS n FROM embeddings WHERE vec_id // 64 < (SELECT count(*) // 64 FROM embeddings) GROUP BY 1",
        "replayed_epochs": """WITH t AS (SELECT count(*) AS n, count(*) // 64 * 64 AS whole FROM embeddings), e AS (SELECT unnest(range(0, 8))::INTEGER AS epoch)
            SELECT epoch, count(*) AS n, max(vec_id) AS last_row FROM embeddings, t, e WHERE vec_id < whole AND epoch * whole + vec_id < 2 * n GROUP BY epoch""",
        "label_filter_count": "SELECT label, count(*) AS n FROM embeddings WHERE label NOT IN (0, 3) GROUP BY label",
        "store_size": "SELECT count(DISTINCT vec_id // 4) AS n_examples, count(DISTINCT vec_id // 4) * 4 * 2 * 64 * 4 AS n_bytes FROM embeddings",
        "codes_relu": b("", "SELECT row, feature, round(value, 6) AS value FROM codes"),
        "codes_topk": b("", "SELECT row, feature, round(h, 6) AS value FROM h QUALIFY row_number() OVER (PARTITION BY row ORDER BY h DESC, feature) <= 4"),
        "codes_batch_topk": b("", "SELECT row // 50 AS batch, row, feature, round(h, 6) AS value FROM h QUALIFY row_number() OVER (PARTITION BY row // 50 ORDER BY h DESC, row, feature) <= 200"),
        "codes_jumprelu": b("", "SELECT row, feature, round(h, 6) AS value FROM h WHERE h > 0.05"),
        "decode_prefixes": b(recon("8, 16, 32"), "SELECT row, prefix, round(sqrt(sum(y * y)), 6) AS size, round(sum((x - y) * (x - y)), 6) AS sse FROM hat GROUP BY row, prefix"),
        "feature_edit": b(
            ", f AS (SELECT row, greatest(h, 0) AS f FROM h WHERE feature = 3)",
            """SELECT dims.row, round(sqrt(sum((v + (0.5 - f) * c / s) * (v + (0.5 - f) * c / s))), 6) AS size, round(sum(((0.5 - f) * c / s) * ((0.5 - f) * c / s)), 6) AS moved
            FROM dims JOIN f USING (row) JOIN proto ON proto.d = dims.d AND proto.feature = 3 JOIN size ON size.feature = 3 GROUP BY dims.row""",
        ),
        "feature_stats": b("", f"SELECT {stats_row} FROM stats"),
        "feature_stats_masked": b(
            "",
            """SELECT feature, count(value) AS nnz, round(coalesce(sum(value), 0), 6) AS sum, round(CASE WHEN count(value) > 0 THEN sum(value) / count(value) END, 6) AS mean_value, round(count(value) / (SELECT n FROM total)::DOUBLE, 6) AS sparsity
            FROM features LEFT JOIN (SELECT * FROM codes WHERE label NOT IN (0, 3)) USING (feature) GROUP BY feature""",
        ),
        "recon_metrics": b(
            recon("32") + ", q AS (SELECT d, count(*) AS n, sum(x) AS s, sum(x * x) AS q, sum((x - y) * (x - y)) AS e FROM hat GROUP BY d), m AS (SELECT max(n) AS n_tokens, count(*) AS d_model, sum(e) AS e, sum(q) - sum(s * s / n) AS b FROM q)",
            """SELECT n_tokens, d_model, round(e, 6) AS sse_recon, round(b, 6) AS sse_baseline, round(e / b, 6) AS nmse, round(e / (n_tokens * d_model), 6) AS mse_per_dim, round(e / n_tokens, 6) AS mse_per_token,
            round(b / (n_tokens * d_model), 6) AS baseline_per_dim, round(b / n_tokens, 6) AS baseline_per_token FROM m""",
        ),
        "explained_variance": b(recon("32"), "SELECT round(1 - var_samp(x - y) / var_samp(x), 6) AS explained FROM hat"),
        "aux_loss": b(
            """, last AS (SELECT feature, coalesce(max(row), -1) AS l FROM features LEFT JOIN (SELECT * FROM codes WHERE value > 0.4) USING (feature) GROUP BY feature), dead AS (SELECT feature FROM last, total WHERE n - 1 - l >= 100),
            used AS (SELECT row, feature, value, 'alive' AS side FROM codes WHERE feature NOT IN (SELECT feature FROM dead)
              UNION ALL SELECT row, feature, value, 'aux' FROM (SELECT row, feature, value FROM codes WHERE feature IN (SELECT feature FROM dead) QUALIFY row_number() OVER (PARTITION BY row ORDER BY value DESC, feature) <= 4)),
            part AS (SELECT row, d, sum(value * c / s) AS v FROM used JOIN proto USING (feature) JOIN size USING (feature) GROUP BY row, d)""",
            "SELECT round(avg((dims.v - coalesce(part.v, 0)) * (dims.v - coalesce(part.v, 0))), 6) AS aux_mse FROM dims LEFT JOIN part USING (row, d)",
        ),
        "eval_summary": b(
            "",
            """SELECT round((SELECT count(*) FROM codes) / n::DOUBLE, 6) AS l0, round((SELECT sum(value) FROM codes) / n, 6) AS l1, (SELECT count_if(sparsity = 0) FROM stats)::BIGINT AS n_dead,
            (SELECT count_if(sparsity < 1e-7) FROM stats)::BIGINT AS n_almost_dead, (SELECT count_if(sparsity > 1e-2) FROM stats)::BIGINT AS n_dense FROM total""",
        ),
        "log_range_features": b("", "SELECT feature, round(sparsity, 6) AS sparsity, round(mean_value, 6) AS mean_value FROM stats WHERE nnz > 0 AND log10(sparsity) > -0.5 AND log10(sparsity) < 0 AND log10(mean_value) > -2 AND log10(mean_value) < -0.5"),
        "rms_scale": b("", "SELECT feature, round(greatest(coalesce(sqrt(avg(value * value)), 1), 1e-6), 6) AS qx FROM features LEFT JOIN codes USING (feature) GROUP BY feature"),
        "support_by_class": b("", "SELECT feature, label, round(count(*) / any_value(total)::DOUBLE, 6) AS support, round(sum(value) / any_value(total), 6) AS mean_act FROM codes JOIN npos ON label = class GROUP BY feature, label"),
        "dead_tracker": b("", "SELECT feature, (any_value(n) - 1 - coalesce(max(row), -1))::BIGINT AS since, any_value(n) - 1 - coalesce(max(row), -1) >= 100 AS dead FROM features CROSS JOIN total LEFT JOIN (SELECT * FROM codes WHERE value > 0.4) USING (feature) GROUP BY feature"),
        "batch_entropy": """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), t AS (SELECT sum(n) AS t FROM c)
            SELECT round(-sum(n / t * ln(n / t)), 6) AS entropy, round(-sum(n / t * ln(n / t)) / ln(1000), 6) AS normalised, round(count(*) / 1000.0, 6) AS coverage FROM c, t""",
        "label_entropy": b(
            FIXED + ", c AS (SELECT feature, label, count(*) AS n FROM above GROUP BY feature, label), t AS (SELECT feature, sum(n) AS t FROM c GROUP BY feature)",
            """SELECT feature, coalesce(any_value(t), 0)::BIGINT AS support, round(-sum(n / t * ln(n / t)), 6) AS entropy, round(1 + sum(n / t * ln(n / t)) / ln(10), 6) AS concentration
            FROM features LEFT JOIN c USING (feature) LEFT JOIN t USING (feature) GROUP BY feature""",
        ),
        "token_label_majority": "SELECT vec_id // 4 AS example_idx, label, count(*) AS n FROM embeddings GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY vec_id // 4 ORDER BY count(*) DESC, label) = 1",
        "token_label_prefer_fg": "SELECT vec_id // 4 AS example_idx, label % 3 AS label, count(*) AS n FROM embeddings GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY vec_id // 4 ORDER BY label % 3 = 0, count(*) DESC, label % 3) = 1",
        "pixel_patches": """SELECT example_idx, token_idx, label FROM (
            SELECT vec_id // 64 AS example_idx, (vec_id % 64 // 8 // 2 * 4 + vec_id % 8 // 2)::INTEGER AS token_idx, label % 4 AS label, count(*) AS n FROM embeddings GROUP BY 1, 2, 3)
            QUALIFY row_number() OVER (PARTITION BY example_idx, token_idx ORDER BY n DESC, label) = 1""",
        "patch_grid": """WITH i AS (SELECT p_partkey, (p_partkey % 40 + 1) * 6 AS n, p_partkey % 7 + 1 AS width, p_partkey % 5 + 1 AS height FROM part), s AS (SELECT *, unnest(range(1, n + 1)) AS w FROM i)
            SELECT p_partkey, w::INTEGER AS w, (n // w)::INTEGER AS h FROM s WHERE n % w = 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(w / (n // w)::DOUBLE - width / height::DOUBLE), w) = 1""",
        "pure_patch_counts": """WITH c AS (SELECT vec_id // 4 AS e, label % 3 AS label, count(*) AS n FROM embeddings GROUP BY 1, 2), s AS (SELECT e, arg_max(label, (n, -label)) AS label, max(n) / sum(n) AS share FROM c GROUP BY e)
            SELECT k.label, count(s.e) AS n FROM (SELECT unnest([0, 1, 2])::INTEGER AS label) k LEFT JOIN s ON s.label = k.label AND share >= 0.75 GROUP BY k.label""",
        "class_iou": """WITH g AS (SELECT label, 'near' AS model, (vec_id % 10)::INTEGER AS pred FROM embeddings UNION ALL SELECT label, 'low', least(label, 4) FROM embeddings), c AS (SELECT unnest(range(0, 9))::INTEGER AS class)
            SELECT model, class AS label, round(CASE WHEN count_if(pred = class OR label = class) > 0 THEN count_if(pred = class AND label = class) / count_if(pred = class OR label = class)::DOUBLE END, 6) AS iou FROM g CROSS JOIN c GROUP BY model, class""",
        "balanced_accuracy": """WITH g AS (SELECT label, model, least(label, model) AS pred FROM embeddings CROSS JOIN (SELECT unnest([2, 5, 8])::INTEGER AS model)), c AS (SELECT model, label, count(*) AS n, count_if(label = pred) AS r FROM g GROUP BY model, label)
            SELECT model, round(sum(r) / sum(n), 6) AS accuracy, round(avg(r / n::DOUBLE), 6) AS balanced, round(max(n) / sum(n), 6) AS majority FROM c GROUP BY model""",
        "intervention_report": """WITH g AS (SELECT label AS b, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS a FROM embeddings), c AS (SELECT b, count_if(a <> b) / count(*)::DOUBLE AS s FROM g GROUP BY b),
            m AS (SELECT a, count(*) AS n FROM g WHERE b = 4 AND a <> 4 GROUP BY a)
            SELECT round(max(s) FILTER (b = 4), 6) AS target_changed, round(avg(s) FILTER (b <> 4), 6) AS other_changed, round(stddev_pop(s) FILTER (b <> 4), 6) AS other_std, (SELECT string_agg(a || ':' || n, ',' ORDER BY a) FROM m) AS went FROM c""",
        "pool_max": b("", "SELECT example_idx, feature, round(max(value), 6) AS value FROM codes GROUP BY example_idx, feature"),
        "pool_mean": b("", "SELECT example_idx, feature, round(sum(value) / 4, 6) AS value FROM codes GROUP BY example_idx, feature"),
        "pool_sum": b("", "SELECT example_idx, feature, round(sum(value), 6) AS value FROM codes GROUP BY example_idx, feature"),
        "topk_per_feature": b(
            ", t AS (SELECT feature, row, value, row_number() OVER (PARTITION BY feature ORDER BY value DESC, row) AS rank FROM codes), k AS (SELECT unnest(range(1, 17))::INTEGER AS rank)",
            "SELECT feature, k.rank, coalesce(row, 0) AS row, round(coalesce(value, 0), 6) AS value FROM features CROSS JOIN k LEFT JOIN t USING (feature, rank)",
        ),
        "topk_per_row": b(
            ", d AS (SELECT row, CASE WHEN h > 0.1 THEN feature ELSE 0 END AS feature, CASE WHEN h > 0.1 THEN h ELSE 0 END AS value, (h <= 0.1)::INTEGER AS zero FROM h)",
            "SELECT row, row_number() OVER (PARTITION BY row ORDER BY value DESC, zero, feature)::INTEGER AS rank, feature, round(value, 6) AS value FROM d QUALIFY row_number() OVER (PARTITION BY row ORDER BY value DESC, zero, feature) <= 3",
        ),
        "topk_examples": b(
            ", t AS (SELECT feature, row // 4 AS example_idx, row_number() OVER (PARTITION BY feature ORDER BY value DESC, row) AS rank FROM codes QUALIFY row_number() OVER (PARTITION BY feature ORDER BY value DESC, row) <= 16), f AS (SELECT feature, example_idx, min(rank) AS r FROM t GROUP BY 1, 2)",
            "SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY r)::INTEGER AS rank, example_idx FROM f",
        ),
        "topk_orders_by_part": """WITH m AS (SELECT l_suppkey AS feature, l_orderkey AS row, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)
            SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY value DESC, row)::INTEGER AS rank, row, round(value, 6) AS value FROM m QUALIFY row_number() OVER (PARTITION BY feature ORDER BY value DESC, row) <= 5""",
        "farthest_points": b(", d4 AS (SELECT row, feature AS center, list_distance(x, wv) AS d FROM act CROSS JOIN w WHERE feature < 4), n4 AS (SELECT row, arg_min(center, (round(d, 12), center)) AS center, min(d) AS distance FROM d4 GROUP BY row)", "SELECT row, center, round(distance, 6) AS distance FROM n4 ORDER BY n4.distance DESC, row LIMIT 8"),
        "exact_subset": "SELECT vec_id AS row, label FROM embeddings ORDER BY md5('3:' || vec_id) LIMIT 50",
        "auroc_by_feature": b(
            TIES + ", u AS (SELECT feature, class, sum(pos * (below + (n + 1) / 2.0)) AS r, sum(pos) AS p, sum(n - pos) AS m FROM placed GROUP BY feature, class), a AS (SELECT feature, class, CASE WHEN p > 0 AND m > 0 THEN (r - p * (p + 1) / 2.0) / (p * m) END AS auroc FROM u)",
            "SELECT feature, class, round(auroc, 6) AS auroc, round(abs(auroc - 0.5), 6) AS selectivity FROM a",
        ),
        "ap_by_class": """WITH k AS (SELECT lang, quality AS y, row_number() OVER w AS k, sum(quality) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id))
            SELECT lang, round(CASE WHEN sum(y) > 0 THEN sum(CASE WHEN y = 1 THEN tp / k ELSE 0 END) / sum(y) ELSE 0 END, 6) AS ap FROM k GROUP BY lang""",
        "ap_tie_aware": b(TIES, "SELECT feature, class, round(ap, 6) AS ap FROM tap"),
        "macro_ap_skip_undefined": b(TIES, "SELECT feature, round(avg(ap) FILTER (total > 0 AND class < 6), 6) AS macro_ap FROM tap GROUP BY feature"),
        "prf1_threshold": b(PRF, "SELECT feature, class, round(tau, 6) AS tau, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf"),
        "best_feature_per_class": b(
            PRF + ", r AS (SELECT class, feature, tau, round(CASE WHEN sparsity < 0.9 THEN f1 ELSE -1 END, 6) AS f1 FROM prf JOIN stats USING (feature))",
            "SELECT class, feature, round(tau, 6) AS tau, f1 FROM r QUALIFY row_number() OVER (PARTITION BY class ORDER BY f1 DESC, r.tau, feature) = 1",
        ),
        "quantile_f1": b(
            FIXED + ", on_ AS (SELECT feature, row, label FROM above), p AS (SELECT feature, count(*) AS n FROM on_ GROUP BY feature), t AS (SELECT feature, label AS class, count(*) AS tp FROM on_ GROUP BY 1, 2), j AS (SELECT feature, class, coalesce(tp, 0) AS tp, coalesce(n, 0) AS n, total FROM features CROSS JOIN npos LEFT JOIN p USING (feature) LEFT JOIN t USING (feature, class))",
            "SELECT feature, class, round(CASE WHEN n > 0 THEN tp / n::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN total > 0 THEN tp / total::DOUBLE ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (n + total)::DOUBLE ELSE 0 END, 6) AS f1 FROM j",
        ),
        "purity_at_k": b(
            ", t AS (SELECT feature, label FROM codes QUALIFY row_number() OVER (PARTITION BY feature ORDER BY value DESC, row) <= 16), c AS (SELECT feature, label, count(*) AS n FROM t GROUP BY 1, 2)",
            "SELECT feature, round(max(n) / 16.0, 6) AS purity FROM c GROUP BY feature",
        ),
        "coverage_at_tau": b(TIES + ", m AS (SELECT class, max(ap) AS ap FROM tap GROUP BY class)", "SELECT round(avg((ap > 0.3)::INTEGER), 6) AS coverage FROM m"),
        "yield_at_b": b(
            TIES + ", m AS (SELECT feature, max(ap) AS ap FROM tap GROUP BY feature), o AS (SELECT feature, row_number() OVER (ORDER BY nnz DESC, feature) AS position FROM stats), bu AS (SELECT unnest([3, 10, 30, 100])::INTEGER AS budget)",
            "SELECT budget, round(count_if(position <= budget AND ap >= 0.2) / budget::DOUBLE, 6) AS yield FROM o JOIN m USING (feature) CROSS JOIN bu GROUP BY budget",
        ),
        "audit_union": b("", "SELECT feature FROM (SELECT feature FROM stats ORDER BY nnz DESC, feature LIMIT 5) UNION SELECT feature FROM (SELECT feature FROM stats ORDER BY sum DESC, feature LIMIT 5)"),
        "probe_step": b(PROBE, "SELECT feature, class, round(b, 6) AS b, round(w, 6) AS w FROM par"),
        "probe_loss": b(PROBE, "SELECT feature, class, round(loss, 6) AS loss FROM loss"),
        "probe_confusion": b(
            PROBE + ", y AS (SELECT feature, class, y, 1 / (1 + exp(-z)) > 0.12 AS s FROM z)",
            "SELECT feature, class, count_if(s AND y = 1)::BIGINT AS tp, count_if(s AND y = 0)::BIGINT AS fp, count_if(NOT s AND y = 0)::BIGINT AS tn, count_if(NOT s AND y = 1)::BIGINT AS fn FROM y GROUP BY feature, class",
        ),
        "best_latent_per_class": b(PROBE, "SELECT class, arg_min(feature, (round(loss, 9), feature)) AS feature, round(min(round(loss, 9)), 6) AS loss FROM loss GROUP BY class"),
        "probe_r": b(PROBE + ", m AS (SELECT class, min(round(loss, 9)) AS ce FROM loss GROUP BY class)", "SELECT round(1 - avg(ce) / avg(-(mean * ln(mean) + (1 - mean) * ln(1 - mean))), 6) AS probe_r FROM m JOIN prior USING (class)"),
        "best_prototype_ap": b(
            ties("a", "example_idx % 5 <> 0") + ties("b", "example_idx % 5 = 0") + ", best AS (SELECT class, feature, ap FROM tap_a QUALIFY row_number() OVER (PARTITION BY class ORDER BY ap DESC, feature) = 1)",
            "SELECT class, feature, round(best.ap, 6) AS train_ap, round(tap_b.ap, 6) AS test_ap FROM best JOIN tap_b USING (class, feature)",
        ),
        "kmeans_assign": b(NEAR, "SELECT row, center, round(distance, 6) AS distance FROM near"),
        "kmeans_codes": b(NEAR, "SELECT row, center AS feature, round(1 / (1 + distance), 6) AS value FROM near"),
        "kmeans_step": b(
            NEAR + ", c AS (SELECT center, d, count(*) AS n, avg(v) AS v FROM near JOIN dims USING (row) GROUP BY center, d), used AS (SELECT DISTINCT center FROM near)",
            "SELECT center, n, d::INTEGER AS d, round(v, 6) AS v FROM c",
        ),
        "kmeans_eval": b(NEAR + ", c AS (SELECT center, count(*) AS n, sum(distance * distance) AS s FROM near GROUP BY center)", "SELECT round(sum(s), 6) AS inertia, round(count(*) / 8.0, 6) AS utilisation, round(sum(n) / 8.0, 6) AS mean_population, max(n) AS max_population FROM c"),
        "pca_scatter": b(
            ", cen AS (SELECT row, d, v - m AS c FROM dims JOIN mean USING (d))",
            "SELECT p.d::INTEGER AS i, q.d::INTEGER AS j, round(sum(p.c * q.c) / (any_value(n) - 1), 6) AS covariance FROM cen p JOIN cen q ON p.row = q.row AND p.d <= q.d, total GROUP BY p.d, q.d",
        ),
        "coherence": b("", "SELECT p.feature::BIGINT AS i, q.feature::BIGINT AS j, round(abs(list_inner_product(p.wv, q.wv)), 6) AS coherence FROM w p JOIN w q ON p.feature < q.feature ORDER BY abs(list_inner_product(p.wv, q.wv)) DESC, 1, 2 LIMIT 1"),
        "pareto_nonstrict": f"SELECT p_brand, p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice FROM (SELECT *, {front.format('CURRENT ROW')} FROM part) f WHERE f.p_retailprice = best",
        "pareto_strict": f"SELECT p_brand, p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice FROM (SELECT *, {front.format('1 PRECEDING')} FROM part) f WHERE best IS NULL OR f.p_retailprice < best",
        "run_leaderboard": f"SELECT p_brand, count(*) AS n, round(min(p_retailprice), 6) AS best FROM (SELECT *, {front.format('CURRENT ROW')} FROM part) f WHERE p_retailprice = f.best GROUP BY p_brand",
        "best_per_group": "SELECT c_nationkey, c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer c WHERE c.c_acctbal = (SELECT max(c_acctbal) FROM customer i WHERE i.c_nationkey = c.c_nationkey)",
        "edge_flags": "SELECT p_partkey, p_size = min(p_size) OVER (PARTITION BY p_brand) AS at_min, p_size = max(p_size) OVER (PARTITION BY p_brand) AS at_max FROM part",
        "head_per_group": "SELECT o_custkey, (row_number() OVER w)::INTEGER AS rank, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY orders.o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 3",
        "first_per_group": "SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY orders.o_totalprice, o_orderkey) = 1",
        "global_rank": "SELECT s_suppkey, row_number() OVER (ORDER BY coalesce(s_acctbal, 1e9) DESC, s_suppkey)::INTEGER AS place FROM supplier",
        "label_grouping": """SELECT doc_id, lang, CASE WHEN lang IN ('fr', 'es') THEN 'romance' WHEN lang IN ('de', 'en') THEN 'germanic' END AS "group", CASE WHEN lang IN ('fr', 'es') THEN 2 WHEN lang IN ('de', 'en') THEN 0 ELSE -1 END::INTEGER AS group_id, lang IN ('fr', 'es', 'de', 'en') AS in_task FROM documents""",
        "identity_grouping": "SELECT doc_id, (dense_rank() OVER (ORDER BY source) - 1)::INTEGER AS group_id FROM documents",
        "factorize": """WITH f AS (SELECT o_orderstatus, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS code FROM f)
            SELECT o_orderkey, code FROM orders JOIN c USING (o_orderstatus, o_orderpriority)""",
        "first_seen": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
        "semi_join": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "anti_join": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "left_join_match_rate": "SELECT count(*) AS n, count(l.doc_id) AS matched, round(count(l.doc_id) / count(*)::DOUBLE, 6) AS share FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
        "bounds_join": """WITH b AS (SELECT c_mktsegment, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1)
            SELECT c_custkey, c_mktsegment, round(low, 6) AS low, round(high, 6) AS high FROM customer JOIN b USING (c_mktsegment) WHERE c_acctbal = b.low OR c_acctbal = b.high""",
        "renamed_key_join": "SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey",
        "lookup_collect": "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "key_set_difference": "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
        "union_distinct": "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier",
        "membership_flag": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_toxic FROM documents",
        "onehot_coalesce": "SELECT doc_id, CASE lang WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS category FROM documents",
        "explode_unnest": "SELECT o_custkey, o_orderkey AS run_o_orderkey, round(o_totalprice, 6) AS run_o_totalprice FROM orders",
        "quantile_summary": """SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max,
            round(quantile_cont(l_extendedprice, 0.05), 4) AS q05, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95 FROM lineitem GROUP BY l_returnflag""",
        "task_counts": "SELECT lang, count_if(quality = 1)::BIGINT AS n_true, count_if(quality <> 1)::BIGINT AS n_false, least(count_if(quality = 1), count_if(quality <> 1)) >= 5 AS kept FROM documents JOIN labels USING (doc_id) GROUP BY lang",
        "task_specs": """WITH p AS (SELECT unnest(['en', 'en', 'de', 'fr']) AS l, unnest(['de', 'fr', 'es', 'es']) AS r), v AS (SELECT lang, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS view, count(*) AS n FROM documents GROUP BY 1, 2)
            SELECT l || '-' || r || '-' || a.view AS name, a.view, l AS "left", r AS "right", a.n AS n_left, b.n AS n_right FROM p JOIN v a ON a.lang = l JOIN v b ON b.lang = r AND b.view = a.view WHERE least(a.n, b.n) >= 30""",
        "filter_pack": "SELECT c_custkey FROM customer WHERE ((c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000) OR c_nationkey = 3) AND NOT contains(c_name, '99')",
        "lenient_cast": "SELECT doc_id, TRY_CAST(replace(source, 'src', '') AS INTEGER) AS source_no, TRY_CAST(lang AS INTEGER) AS bad FROM documents",
        "html_trait_parse": r"""WITH t AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g')) AS text FROM pages)
            SELECT page_id, length(text)::BIGINT AS n_text, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>'))::BIGINT AS n_paragraphs, contains(text, 'the') AS has_the FROM t""",
        "scalar_pack": r"""SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, split_part(p_name, ' ', -1) AS last_word, lower(p_brand) AS brand, regexp_replace(p_brand || '/' || p_type, '[^\p{L}\p{N}\-_.]', '_', 'g') AS safe, p_brand || '.tar' AS stem,
            round(log10(p_retailprice), 6) AS log_price, round(1 / (1 + exp(2 - p_size / 10.0)), 6) AS p, round(ln(1 + exp(2 - p_size / 10.0)), 6) AS bce, round(least(greatest(p_retailprice, 950), 1000), 6) AS clipped, round(2595 * log10(1 + p_retailprice / 700), 6) AS mel,
            round(-1 + p_size * 0.02::DOUBLE, 6) AS mapped FROM part""",
        "json_fields": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
        "colours": "SELECT n_nationkey, round(n_nationkey * 10 / 255.0, 6) AS red, round(n_nationkey / 255.0, 6) AS green, 1.0::DOUBLE AS blue FROM nation",
        "content_identity": """SELECT r_regionkey, substr(sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}'), 1, 8) AS id FROM region""",
        "grid_expand": "SELECT * FROM (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)",
        "config_groups": """WITH g AS (SELECT o_orderkey, substr(sha256(coalesce(o_orderpriority, 'null') || '|' || coalesce(o_orderstatus, 'null')), 1, 8) AS group_key FROM orders)
            SELECT o_orderkey, group_key, (row_number() OVER (PARTITION BY group_key ORDER BY o_orderkey) - 1) // 4 AS batch FROM g""",
        "lr_schedule": """SELECT o_orderkey, round(CASE WHEN step < 100 THEN 0.01 * step / 100 WHEN step >= 1000 THEN 0.001 ELSE 0.001 + 0.009 * (1 + cos(pi() * (step - 100) / 900)) / 2 END, 6) AS rate FROM (SELECT o_orderkey, o_orderkey % 1200 AS step FROM orders)""",
        "stream_stats": "SELECT event_type, count(value) AS n, round(avg(value), 5) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY event_type",
        "windowed_activity": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    }
