"""Tuning tables over orders (order key is the trial number, price its value, status its state) and trials fitted to embeddings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from presswork.functions.scores import cross_entropy
from presswork.functions.text import stable_uniform
from presswork.operators import linear, tuning
from presswork.plans import sql_text as s
from presswork.plans.registry import query, table
from presswork.sources import schemas

STATES = {"F": "COMPLETE", "P": "PRUNED", "O": "FAIL"}

LOG = """
log AS (
  SELECT o_orderkey AS number, o_totalprice AS value, o_orderpriority AS rung,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'P' THEN 'PRUNED' ELSE 'FAIL' END AS state FROM orders)
"""


def trial_log(spark, sf_dir):
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("rung"),
        F.when(status == "F", STATES["F"]).when(status == "P", STATES["P"]).otherwise(STATES["O"]).alias("state"))


def _u(name: str) -> str:
    return f"({s.hash8(f'''number || ':{name}' ''')} / 4294967296.0::double)"


SPACE = f"""
draws AS (
  SELECT number, (64 + floor({_u('lstm_units_1')} * 15) * 32)::int AS lstm_units_1, {_u('lstm_units_2')} AS u2,
         (64 + floor({_u('dense_units')} * 15) * 32)::int AS dense_units,
         round(0.2::double + floor({_u('dropout_rate')} * 4) * 0.1::double, 1) AS dropout_rate,
         exp(ln(0.00001::double) + {_u('learning_rate')} * (ln(0.01::double) - ln(0.00001::double))) AS learning_rate,
         (10 + floor({_u('epochs')} * 3) * 10)::int AS epochs, (64 + floor({_u('batch_size')} * 7) * 32)::int AS batch_size
  FROM log),
space AS (
  SELECT number, lstm_units_1,
         (lstm_units_1 // 2 + floor(u2 * ((lstm_units_1 - lstm_units_1 // 2) // 32 + 1)) * 32)::int AS lstm_units_2,
         dense_units, dropout_rate, learning_rate, epochs, batch_size FROM draws)
"""


@query("search_space", sql=f"WITH {LOG}, {SPACE} SELECT * REPLACE (round(learning_rate, 8) AS learning_rate) FROM space")
def search_space(spark, sf_dir):
    space = tuning.search_space(trial_log(spark, sf_dir).select("number"))
    return space.withColumn("learning_rate", F.round("learning_rate", 8))


@query("halving_rung", sql=f"""
WITH {LOG}
SELECT number, rung, value FROM log
QUALIFY rank() OVER (PARTITION BY rung ORDER BY value) <= ceil(count(*) OVER (PARTITION BY rung) / 3.0)""")
def halving_rung(spark, sf_dir):
    return tuning.halving_rung(trial_log(spark, sf_dir), "rung", "value", "number", eta=3).select("number", "rung", "value")


# Trials of centroid models. A quarter of the rows judges; a rung fits on a ninth, a third, or all of the others.
TRIALS, JUDGING = 27, 0.25
RUNGS = {0: 1 / 9, 1: 1 / 3, 2: 1.0}
STRENGTH, SHARPNESS = (0.1, 100.0), (0.1, 100.0)


def _log_even(u, low: float, high: float):
    return F.exp(F.lit(math.log(low)) + u * F.lit(math.log(high / low)))


def _log_even_sql(name: str, low: float, high: float) -> str:
    return f"exp({math.log(low)!r}::double + {_u(name)} * {math.log(high / low)!r}::double)"


def _rung_sql(step: int, share: float) -> str:
    entered = "" if step == 0 else f"WHERE number IN (SELECT number FROM kept{step - 1})"
    return f"""
sums{step} AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM emb WHERE u >= {JUDGING} AND u < {JUDGING + (1 - JUDGING) * share!r}::double GROUP BY ALL),
means{step} AS (SELECT i, sum(s) / sum(n) AS m FROM sums{step} GROUP BY 1),
cells{step} AS (
  SELECT label, i, coalesce(s, 0) AS s, coalesce(n, 0) AS n, m
  FROM (SELECT DISTINCT label FROM emb) CROSS JOIN means{step} LEFT JOIN sums{step} USING (label, i)),
norms{step} AS (SELECT label, max(n) AS n, sum(s * s) AS ss, sum(s * m) AS sm, sum(m * m) AS mm FROM cells{step} GROUP BY 1),
dots{step} AS (
  SELECT vec_id, e.label AS own, c.label, sum(x * s) AS a, sum(x * m) AS b
  FROM emb e JOIN cells{step} c USING (i) WHERE u < {JUDGING} GROUP BY ALL),
scored{step} AS (
  SELECT number, vec_id, own, label, sharpness * ((a + strength * b) / (n + strength)
         - 0.5::double * (ss + 2 * strength * sm + strength * strength * mm) / ((n + strength) * (n + strength))) AS z
  FROM dots{step} JOIN norms{step} USING (label), (SELECT * FROM trials {entered})),
lost{step} AS (
  SELECT number, vec_id, ln(sum(exp(z - top))) + max(top) - max(z) FILTER (label = own) AS l
  FROM (SELECT *, max(z) OVER (PARTITION BY number, vec_id) AS top FROM scored{step}) GROUP BY ALL),
rung{step} AS MATERIALIZED (SELECT number, {step} AS rung, avg(l) AS loss FROM lost{step} GROUP BY number),
kept{step} AS MATERIALIZED (
  SELECT number FROM rung{step} QUALIFY rank() OVER (ORDER BY loss) <= ceil(count(*) OVER () / 3.0))"""


@query("successive_halving", sql=f"""
WITH trials AS (
  SELECT number, {_log_even_sql('strength', *STRENGTH)} AS strength, {_log_even_sql('sharpness', *SHARPNESS)} AS sharpness
  FROM (SELECT unnest(range({TRIALS})) AS number)),
emb AS MATERIALIZED (
  SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i,
         {s.hash8("vec_id || ':rows'")} / 4294967296.0::double AS u
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
{", ".join(_rung_sql(r, share) for r, share in RUNGS.items())}
SELECT number, rung, round(loss, 6) AS loss, survives FROM (
  {" UNION ALL ".join(f"SELECT *, number IN (SELECT number FROM kept{r}) AS survives FROM rung{r}" for r in RUNGS)})""")
def successive_halving(spark, sf_dir):
    """Trials of shrunk centroid models: each rung fits those that are left on three times the rows and takes their held-out log loss."""
    u = stable_uniform(F.concat(F.col("vec_id").cast("string"), F.lit(":rows")))
    usable = table(spark, sf_dir, "embeddings").filter("label is not null and embedding is not null").withColumn("_u", u)
    classes = sorted(r["label"] for r in usable.select("label").distinct().collect())
    place = (F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1).cast("int")
    held = usable.filter(F.col("_u") < JUDGING).select("embedding", place.alias("y"))
    draw = lambda name: stable_uniform(F.concat(F.col("number").cast("string"), F.lit(f":{name}")))
    trials = spark.range(TRIALS).select(F.col("id").alias("number"), _log_even(draw("strength"), *STRENGTH).alias("strength"),
                                        _log_even(draw("sharpness"), *SHARPNESS).alias("sharpness"))

    def judge(entered, step):
        own = (trials if entered is None else trials.join(entered, "number", "left_semi")).orderBy("number").collect()
        seen = usable.filter((F.col("_u") >= JUDGING) & (F.col("_u") < JUDGING + (1 - JUDGING) * RUNGS[step]))
        weights, bias = linear.fit_shrunk_centroids(seen, "label", "embedding", classes, [(t["strength"], t["sharpness"]) for t in own])
        scored = held.select("y", linear.linear_logits(F.col("embedding"), weights, bias).alias("_l"))
        each = scored.select("y", F.posexplode_outer("_l").alias("_at", "_logits")).select(
            "_at", cross_entropy(F.col("_logits"), F.col("y")).alias("_loss"))
        numbers = F.array(*[F.lit(t["number"]) for t in own])
        return each.groupBy(F.get(numbers, F.col("_at")).alias("number")).agg(F.avg("_loss").alias("loss"))

    halved = tuning.judged_halving(judge, list(RUNGS), "rung", "loss", "number", eta=3)
    return halved.withColumn("loss", F.round("loss", 6))


CANDIDATES, PROPOSALS = 400, 20


def _bins_sql(source: str, keep: str) -> str:
    return f"""
SELECT {keep}, unnest(['lstm_units_1', 'lstm_units_2', 'dense_units', 'dropout_rate', 'learning_rate', 'epochs', 'batch_size']) AS param,
       unnest([(lstm_units_1 - 64) // 32, (lstm_units_2 - lstm_units_1 // 2) * 16 // (lstm_units_1 - lstm_units_1 // 2 + 1), (dense_units - 64) // 32,
               round((dropout_rate - 0.2) * 10)::int,
               greatest(least(floor((ln(learning_rate) - ln(0.00001::double)) / (ln(0.01::double) - ln(0.00001::double)) * 16), 15), 0)::int,
               (epochs - 10) // 10, (batch_size - 64) // 32]) AS bin FROM {source}"""


@query("propose_trials", sql=f"""
WITH {LOG}, {SPACE},
new_numbers AS (SELECT (SELECT max(number) FROM log) + unnest(range(1, {CANDIDATES} + 1)) AS number),
{SPACE.replace('FROM log', 'FROM new_numbers').replace('draws', 'new_draws').replace('space', 'new_space')},
placed AS (
  SELECT space.*, row_number() OVER (ORDER BY value DESC, number) <= ceil(count(*) OVER () * 0.25::double) AS good
  FROM space JOIN log USING (number) WHERE state = 'COMPLETE'),
sizes AS (SELECT count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS o FROM placed),
counts AS (SELECT param, bin, good, count(*) AS n FROM ({_bins_sql('placed', 'good')}) GROUP BY ALL),
spread AS (
  SELECT param, bin + d AS bin, sum(CASE WHEN good THEN n * (3 - abs(d)) ELSE 0 END)::double AS good,
         sum(CASE WHEN good THEN 0 ELSE n * (3 - abs(d)) END)::double AS other
  FROM counts, (SELECT unnest(range(-2, 3)) AS d) GROUP BY ALL)
SELECT number, round(sum(ln(((coalesce(good, 0) / 9.0::double + 0.0625::double) / (g + 1))
                            / ((coalesce(other, 0) / 9.0::double + 0.0625::double) / (o + 1)))), 6) AS score
FROM ({_bins_sql('new_space', 'number')}) LEFT JOIN spread USING (param, bin), sizes
GROUP BY number ORDER BY score DESC, number LIMIT {PROPOSALS}""")
def propose_trials(spark, sf_dir):
    """The next trials to run: of 400 new draws the 20 that are most like the best finished trials."""
    log = trial_log(spark, sf_dir)
    finished = tuning.search_space(tuning.complete_trials(log), keep=("value",))
    last = log.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    drawn = tuning.search_space(spark.range(last + 1, last + 1 + CANDIDATES).withColumnRenamed("id", "number"))
    return tuning.propose_trials(finished, drawn, PROPOSALS)


@query("complete_trials", sql=f"WITH {LOG} SELECT number, value, state FROM log WHERE state = 'COMPLETE'")
def complete_trials(spark, sf_dir):
    return tuning.complete_trials(trial_log(spark, sf_dir)).select("number", "value", "state")


BEST = """
best AS (SELECT number, value FROM log WHERE state = 'COMPLETE' ORDER BY value DESC, number LIMIT 1)
"""


def best_with_parameters(spark, sf_dir):
    return tuning.search_space(tuning.best_trial(trial_log(spark, sf_dir)), keep=("value",))


@query("best_trial", sql=f"""
WITH {LOG}, {BEST}, {SPACE}
SELECT number, value, lstm_units_1, lstm_units_2, dense_units, dropout_rate, epochs, batch_size
FROM best JOIN space USING (number)""")
def best_trial(spark, sf_dir):
    return best_with_parameters(spark, sf_dir).drop("learning_rate")


@query("best_params_json", sql=f"""
WITH {LOG}, {BEST}, {SPACE}
SELECT lstm_units_1, lstm_units_2, dense_units, dropout_rate, round(learning_rate, 12) AS learning_rate, epochs, batch_size
FROM best JOIN space USING (number)""")
def best_params_json(spark, sf_dir):
    # parsed again: engines print the last digit of a double in different ways
    text = tuning.best_params_json(best_with_parameters(spark, sf_dir))
    parsed = text.select(F.from_json("value", schemas.BEST_PARAMETERS).alias("p")).select("p.*")
    return parsed.withColumn("learning_rate", F.round("learning_rate", 12))


@query("optimization_history", sql=f"""
WITH {LOG} SELECT number, value, max(value) OVER (ORDER BY number) AS best_so_far FROM log WHERE state = 'COMPLETE'""")
def optimization_history(spark, sf_dir):
    return tuning.optimization_history(tuning.complete_trials(trial_log(spark, sf_dir)))


@query("trial_states", sql=f"WITH {LOG} SELECT state, count(*) AS n_trials FROM log GROUP BY 1")
def trial_states(spark, sf_dir):
    return tuning.trial_states(trial_log(spark, sf_dir))
