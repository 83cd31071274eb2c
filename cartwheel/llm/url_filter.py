"""URL filter: path rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's good
rate is shrunk towards its parent's through a beta-binomial prior whose strength is estimated
from the spread of the siblings; a page is blocked where even the upper bound of its host's
posterior is below the wanted good rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm.beta import posterior_mean, posterior_sd, strength
from cartwheel.llm.common import ascii_lower, materialize, table
from cartwheel.operators.joins import takes_at_most

# Suffixes of two labels under which names are registered (a parameter; every
# other suffix is the last label).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar",
                      "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp",
                      "net.au", "or.jp", "org.au", "org.uk")

# (rule, action) of the registered query.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block"))

MIN_GOOD = 0.5   # wanted share of good pages
Z = 1.96         # posterior standard deviations between mean and bound

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits the host or a parent of it and starts the path, or null."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        here = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(here & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def domain_suffix(host: Column, two_label=TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; user names and ports are ignored."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    last2 = F.substring_index(bare, ".", -2)
    long = last2.isin(list(two_label))
    suffix = F.when(long, last2).otherwise(F.substring_index(bare, ".", -1))
    return F.when(long, F.substring_index(bare, ".", -3)).otherwise(last2), suffix


def host_reputation(outcomes: DataFrame, *, two_label=TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, good: 0/1) -> one row per host: host, domain, suffix, n, mean, sd.

    Rows without host or outcome are ignored; no rows give no hosts. The three levels are
    counts of counts, so the shuffles carry one row per host and task at most; the counts per
    host are stored, as each level reads them several times.
    """
    domain, suffix = domain_suffix(F.col("host"), two_label)
    counted = (outcomes.where("host IS NOT NULL AND good IS NOT NULL")
               .groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("k")))
    counted = materialize(counted, "host-outcomes")
    hosts = counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1)).alias("m0"))

    def shrink(level: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
        """level joined to its parents' means, its own posterior mean and deviation."""
        known = level.join(parent, on) if on else level.withColumn("m0", parent.scalar())
        s = known.agg(strength(F.col("n"), F.col("k"), F.col("m0")))
        known = known.withColumn("s", s.scalar())
        mean = posterior_mean(F.col("n"), F.col("k"), F.col("m0"), F.col("s"))
        return (known.withColumn("mean", mean)
                .withColumn("sd", posterior_sd(F.col("n"), F.col("mean"), F.col("s"))))

    by_suffix = shrink(suffixes, total, [])
    by_domain = shrink(domains, by_suffix.select("suffix", F.col("mean").alias("m0")), ["suffix"])
    by_host = shrink(hosts, by_domain.select("domain", "suffix", F.col("mean").alias("m0")),
                     ["domain", "suffix"])
    return by_host.select("host", "domain", "suffix", "n", "mean", "sd")


def filter_urls(pages: DataFrame, outcomes: DataFrame, *, rules=RULES, min_good: float = MIN_GOOD,
                z: float = Z, two_label=TWO_LABEL_SUFFIXES) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url) with ``outcomes`` (page_id, good 0/1 or null).

    Returns page_id, host, path, rule, verdict, host_good, host_labels. A null url, or one
    without ``://``, has an empty host and path and is judged like a host of that name. Hosts
    without any labelled page are allowed, as nothing speaks against them; repeated
    ``page_id`` rows are judged row by row and each counts; several outcomes of one page
    count as one, the worst. Other columns of the inputs are ignored.
    """
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"),
                          url_path(F.col("url")).alias("path"))
    worst = (outcomes.where("good IS NOT NULL").groupBy("page_id")
             .agg(F.min("good").alias("good")))
    hosts = host_reputation(judged.select("page_id", "host").join(worst, "page_id"),
                            two_label=two_label)
    hosts = hosts.select("host", F.col("n").alias("host_labels"), F.col("mean").alias("host_good"),
                         (F.col("mean") + z * F.col("sd") < min_good).alias("bad"))
    hosts = materialize(hosts, "hosts")
    hosts = F.broadcast(hosts) if takes_at_most(hosts) else hosts  # a hot host's pages stay where they are
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    action = F.lit(None).cast("string")
    for name, verdict in rules:
        action = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(action)
    method = F.when(F.coalesce(F.col("bad"), F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return (judged.withColumn("rule", rule).join(hosts, "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce(action, method).alias("verdict"), "host_good",
                    F.coalesce("host_labels", F.lit(0)).alias("host_labels")))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, good): of good quality and not toxic; null where a label is missing."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return labels.select(F.col("doc_id").alias("page_id"), good.cast("int").alias("good"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages"), page_outcomes(table(spark, sf_dir, "labels")))
    return out.withColumn("host_good", F.round("host_good", 6))


OP2_SQL = r"""
WITH judged AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
outcome AS (
  SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, string_split(host, '.') AS parts, count(*) AS n, sum(good) AS k
  FROM judged JOIN outcome USING (page_id) GROUP BY host),
named AS (
  SELECT host, array_to_string(parts[-2:], '.') AS domain, parts[-1] AS suffix, n, k FROM hosts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
s_in AS (
  SELECT *, (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1) FROM suffixes) AS m FROM suffixes),
s_rho AS (
  SELECT sum((k - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) AS r FROM s_in),
s_out AS (
  SELECT suffix, (s * m + k) / (s + n) AS m
  FROM s_in, (SELECT 1 / greatest(0.001, least(0.5, r)) - 1 AS s FROM s_rho)),
d_in AS (SELECT d.*, o.m FROM domains d JOIN s_out o USING (suffix)),
d_rho AS (
  SELECT sum((k - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) AS r FROM d_in),
d_out AS (
  SELECT domain, (s * m + k) / (s + n) AS m
  FROM d_in, (SELECT 1 / greatest(0.001, least(0.5, r)) - 1 AS s FROM d_rho)),
h_in AS (SELECT h.*, o.m FROM named h JOIN d_out o USING (domain)),
h_rho AS (
  SELECT sum((k - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) AS r FROM h_in),
h_out AS (
  SELECT host, n, s + n AS weight, (s * m + k) / (s + n) AS m
  FROM h_in, (SELECT 1 / greatest(0.001, least(0.5, r)) - 1 AS s FROM h_rho)),
fits AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule
  FROM judged, (VALUES ('com/'), ('example.com/en/'), ('www.example.com/en/'), ('net/es/'),
                       ('net/fr/')) r(rule)
  WHERE ('.' || host) LIKE '%.' || split_part(rule, '/', 1)
    AND starts_with(path, substr(rule, instr(rule, '/')))
  GROUP BY page_id)
SELECT page_id, judged.host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN m + 1.96 * sqrt(m * (1 - m) / (weight + 1)) < 0.5 THEN 'block'
            ELSE 'allow' END AS verdict,
       round(m, 6) AS host_good, coalesce(n, 0) AS host_labels
FROM judged LEFT JOIN fits USING (page_id) LEFT JOIN h_out ON h_out.host = judged.host
"""

QUERIES = {"op2_url_filter": op2_url_filter}
ORACLE_SQL = {"op2_url_filter": OP2_SQL}
