"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path.

The rules and the model's weights are constants of the plan; URLs are scored
with SQL functions alone, in one narrow pass.  The model is trained on the
driver from ``LABELLED_URLS``, a table of a few dozen rows (give your own to
``train``; it is meant to be small, MAX_LABELLED rows at most are accepted).

Edge cases.  A null URL or one without ``://`` has an empty host and path; no
rule fits it and the model scores its bias alone.  Repeated rows are judged
alike.  Very long URLs are scored whole.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_BUCKETS = 4096
MAX_LABELLED = 100_000
#: (rule, verdict); a rule is host + path prefix
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: (url, 1: block)
LABELLED_URLS = tuple(
    [(f"http://{host}{path}", 1) for host in (
        "spam-farm.example.org", "spam-links.example.com", "www.linkfarm.example.com", "casino-bonus.example.org",
        "free-casino.example.com", "cheap-pills.example.org", "online-pharmacy-pills.example.com", "xxx-adult.example.org",
        "adult-video.example.com", "free-money-now.example.org", "click-bait.example.com", "win-prize.example.org",
        "ad-tracker.example.com", "poker-slots.example.org", "malware-download.example.com", "phishing-login.example.org",
    ) for path in ("/", "/en/12", "/offer/free", "/de/7.html")]
    + [(f"https://{host}{path}", 0) for host in (
        "www.example.org", "blog.example.com", "m.example.org", "news.example.com", "library.example.org", "docs.example.com",
        "en.encyclopedia.example.org", "blog.there.example.com", "m.nation.example.org", "www.then.example.com",
        "thing.example.org", "ththe.example.com", "tion.example.org", "therhe.example.com", "than.example.org", "museum.example.com",
    ) for path in ("/", "/en/825", "/fr/25.html", "/es/685", "/de/41/", "/article/history", "/science/2020/report")]
)


def _grams(s: str) -> list[str]:
    return [s[i : i + 4] for i in range(max(0, len(s) - 3))]


def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:3], 16)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, as the SQL form takes them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def _key(host: str, path: str) -> str:
    return f"^{host}{path}$" if host or path else ""


def train(labelled=LABELLED_URLS, epochs: int = 300, rate: float = 2.0, decay: float = 1e-4) -> tuple[list[float], float]:
    """(weights, bias) by batch gradient descent; labels are balanced by weight."""
    labelled = list(labelled)
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table must be small: at most {MAX_LABELLED} rows")
    w, bias = [0.0] * N_BUCKETS, 0.0
    ones = sum(y for _, y in labelled)
    share = {1: 0.5 / max(1, ones), 0: 0.5 / max(1, len(labelled) - ones)}
    rows = []
    for url, y in labelled:
        grams = [_bucket(g) for g in _grams(_key(*split_url(url)))]
        rows.append((grams, 1 / math.sqrt(max(1, len(grams))), y))
    for _ in range(epochs):
        step, step0 = {}, 0.0
        for grams, scale, y in rows:
            z = bias + scale * sum(w[g] for g in grams)
            err = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * share[y]
            step0 += err
            for g in grams:
                step[g] = step.get(g, 0.0) + err * scale
        bias -= rate * step0
        for g, d in step.items():
            w[g] -= rate * (d + decay * w[g])
    return [round(x, 6) for x in w], round(bias, 6)


def _host_path(url: Column) -> tuple[Column, Column]:
    """An absent host or path is empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, by a chain of conditions (longest first)."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        name, prefix = rule[:at], rule[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, model=None, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and block_score added.

    Existing columns of those names are replaced; all others stay, whatever their names.
    """
    weights, bias = model or train()
    host, path = _host_path(F.col(url_col))
    out = pages.withColumns({"host": host, "path": path})
    out = out.withColumn("rule", _rule(F.col("host"), F.col("path"), rules))
    k = "url_key"
    while k in out.columns:
        k = f"_{k}"
    key = F.when((F.col("host") == "") & (F.col("path") == ""), F.lit("")).otherwise(F.concat(F.lit("^"), "host", "path", F.lit("$")))
    table = F.expr("array(" + ",".join(f"{x!r}D" for x in weights) + ")")
    n = F.length(k)
    sums = F.aggregate(
        F.when(n >= 4, F.sequence(F.lit(1), n - 3)).otherwise(F.array().cast("array<int>")),
        F.lit(0.0),
        lambda acc, i: acc
        + F.get(table, F.conv(F.substr(F.md5(F.substring(F.col(k), i, F.lit(4)).cast("binary")), F.lit(1), F.lit(3)), 16, 10).cast("int")),
    )
    z = F.lit(bias) + sums / F.sqrt(F.greatest(F.lit(1.0), (n - 3).cast("double")))
    verdict = F.lit(None).cast("string")
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    out = out.withColumn(k, key).withColumn("block_score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    learnt = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce(verdict, learnt)).drop(k)


def oracle() -> str:
    """The query's result in DuckDB SQL."""
    weights, bias = train()
    chain = "NULL"
    for rule, _ in sorted(RULES, key=lambda r: (len(r[0]), r[0])):
        name, prefix = rule[: rule.index("/")], rule[rule.index("/") :]
        chain = f"CASE WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{prefix}') THEN '{rule}' ELSE {chain} END"
    says = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
k AS (SELECT *, {chain} AS rule, CASE WHEN host = '' AND path = '' THEN '' ELSE '^' || host || path || '$' END AS k FROM s),
w AS (SELECT {weights!r}::DOUBLE[] AS w),
z AS (SELECT page_id, host, path, rule, {bias} + coalesce(list_sum(list_transform(range(1, greatest(1, length(k) - 2)),
  lambda i: w[('0x' || substr(md5(substr(k, i, 4)), 1, 3))::INT + 1])), 0.0) / sqrt(greatest(1.0, (length(k) - 3)::DOUBLE)) AS z FROM k, w)
SELECT page_id, host, path, rule, CASE {says} WHEN 1.0 / (1.0 + exp(-z)) >= 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM z"""
