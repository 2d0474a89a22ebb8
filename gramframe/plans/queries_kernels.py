"""Phase 3/4 queries: encoding, gate tables, pairs, kernels, kernel statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import encode, kernels, prep, sampling
from ..operators import kernel_stats as ks
from ..sources.fixtures import FEATURES, KEY, TARGET, fixture_e
from .params import CIRCUIT_REPETITIONS, REMOTE_SHOTS, REMOTE_SUBSET, SEED
from .queries_sampling import SUBSET, subset_w, test_w
from .registry import query

N = len(FEATURES)


def prepared(spark, sf_dir, size=SUBSET, seed=SEED):
    """(subset scaled, test split scaled with the subset's fit), both with angles a0..a8."""
    sub = subset_w(spark, sf_dir, size, seed)
    p = prep.fit_preprocessor(sub, FEATURES, rows_per_group=size)
    sub_s = p.transform(sub)
    test_s = p.transform(test_w(spark, sf_dir))
    return sub_s, test_s


def encoded(spark, sf_dir, size=SUBSET, seed=SEED):
    sub_s, test_s = prepared(spark, sf_dir, size, seed)
    return encode.encode_angles(sub_s, FEATURES), encode.encode_angles(test_s, FEATURES)


@query("q_angle_encode")
def q_angle_encode(spark, sf_dir):
    _, test_e = encoded(spark, sf_dir)
    return test_e.select(KEY, *[r6(f"a{q}").alias(f"a{q}") for q in range(N)])


def _params(spark, sf_dir, name):
    sub_e, _ = encoded(spark, sf_dir)
    t = encode.map_parameters(sub_e, KEY, name, CIRCUIT_REPETITIONS, N)
    return t.withColumn("angle", r6("angle"))


@query("q_map_params_zz")
def q_map_params_zz(spark, sf_dir):
    return _params(spark, sf_dir, "zz")


@query("q_map_params_pauli")
def q_map_params_pauli(spark, sf_dir):
    return _params(spark, sf_dir, "pauli")


@query("q_map_params_custom")
def q_map_params_custom(spark, sf_dir):
    return _params(spark, sf_dir, "custom")


@query("q_map_gate_count")
def q_map_gate_count(spark, sf_dir):
    sub_e, _ = encoded(spark, sf_dir)
    tables = [encode.map_parameters(sub_e, KEY, m, CIRCUIT_REPETITIONS, N) for m in ("zz", "pauli", "custom")]
    allp = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return encode.gate_counts(allp)


@query("q_pairs_symmetric")
def q_pairs_symmetric(spark, sf_dir):
    sub_e, _ = encoded(spark, sf_dir)
    k = kernels.fidelity_kernel(sub_e, sub_e, "pauli", 1, N, symmetric=True)
    return k.select("i_key", "j_key", "i_pos", "j_pos")


@query("q_pairs_rect")
def q_pairs_rect(spark, sf_dir):
    sub_e, test_e = encoded(spark, sf_dir)
    return kernels.fidelity_kernel(test_e, sub_e, "pauli", 1, N).select("i_key", "j_key")


def _sym_kernel(spark, sf_dir, name, reps):
    sub_e, _ = encoded(spark, sf_dir)
    k = kernels.fidelity_kernel(sub_e, sub_e, name, reps, N, symmetric=True)
    return k.select("i_key", "j_key", r6("k").alias("k"))


@query("q_kernel_pauli")
def q_kernel_pauli(spark, sf_dir):
    return _sym_kernel(spark, sf_dir, "pauli", CIRCUIT_REPETITIONS)


@query("q_kernel_custom_r1")
def q_kernel_custom_r1(spark, sf_dir):
    return _sym_kernel(spark, sf_dir, "custom", 1)


@query("q_kernel_custom_r2")
def q_kernel_custom_r2(spark, sf_dir):
    return _sym_kernel(spark, sf_dir, "custom", 2)


@query("q_kernel_zz_r1")
def q_kernel_zz_r1(spark, sf_dir):
    return _sym_kernel(spark, sf_dir, "zz", 1)


@query("q_kernel_zz_r2")
def q_kernel_zz_r2(spark, sf_dir):
    return _sym_kernel(spark, sf_dir, "zz", 2)


@query("q_kernel_pauli_test")
def q_kernel_pauli_test(spark, sf_dir):
    """Rectangular kernel: whole test split x the 64-row subset (native expressions)."""
    sub_e, test_e = encoded(spark, sf_dir)
    k = kernels.fidelity_kernel(test_e, sub_e, "pauli", CIRCUIT_REPETITIONS, N)
    return k.select("i_key", "j_key", r6("k").alias("k"))


@query("q_kernel_custom_r2_test")
def q_kernel_custom_r2_test(spark, sf_dir):
    """Rectangular kernel: whole test split x the 64-row subset (Arrow batches)."""
    sub_e, test_e = encoded(spark, sf_dir)
    k = kernels.fidelity_kernel(test_e, sub_e, "custom", 2, N)
    return k.select("i_key", "j_key", r6("k").alias("k"))


@query("q_gamma_scale")
def q_gamma_scale(spark, sf_dir):
    sub_s, _ = prepared(spark, sf_dir)
    s = kernels.gamma_value(sub_s, FEATURES, "scale").select(r6("gamma").alias("gamma_scale"))
    return s.select("gamma_scale", F.lit(1.0 / N).alias("gamma_auto"))


@query("q_kernel_rbf")
def q_kernel_rbf(spark, sf_dir):
    sub_s, _ = prepared(spark, sf_dir)
    g = kernels.gamma_value(sub_s, FEATURES, "scale").first()["gamma"]
    k = kernels.rbf_kernel(sub_s, sub_s, FEATURES, g, symmetric=True)
    return k.select("i_key", "j_key", r6("k").alias("k"))


@query("q_kernel_vectors")
def q_kernel_vectors(spark, sf_dir):
    """Every embedding against a balanced subset of 64 embeddings: <u, v>^2."""
    e = fixture_e(spark, sf_dir)
    lm = sampling.balanced_subset(e, TARGET, KEY, SUBSET, SEED)
    k = kernels.vector_kernel(e, lm, "vec", 64)
    return k.select("i_key", "j_key", r6("k").alias("k"))


@query("q_pair_budget")
def q_pair_budget(spark, sf_dir):
    n_test = test_w(spark, sf_dir).agg(F.count(F.lit(1)).alias("m"))
    return n_test.select(*kernels.pair_budget(REMOTE_SUBSET, F.col("m"), REMOTE_SHOTS))


@query("q_kernel_sanity")
def q_kernel_sanity(spark, sf_dir):
    """Both halves computed independently, then: max |K_ij - K_ji|, max |K_ii - 1|, range, and the verdict within the
    tolerances."""
    sub_e, _ = encoded(spark, sf_dir)
    k = kernels.fidelity_kernel(sub_e, sub_e, "pauli", CIRCUIT_REPETITIONS, N)
    t = k.select(F.col("j_key").alias("i_key"), F.col("i_key").alias("j_key"), F.col("k").alias("kt"))
    both = k.join(t, ["i_key", "j_key"])
    checked = ks.within_tolerance(both.agg(
        F.max(F.abs(F.col("k") - F.col("kt"))).alias("max_asymmetry"),
        F.max(F.when(F.col("i_key") == F.col("j_key"), F.abs(F.col("k") - 1))).alias("max_diagonal_error"),
        F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.count(F.lit(1)).alias("entries")))
    return checked.select(*[r6(c).alias(c) for c in ("max_asymmetry", "max_diagonal_error", "min_k", "max_k")], "entries",
                          "symmetric", "unit_diagonal", "in_range")
