"""Policies and request rules: statements, globs, names, ranges, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def glob(value: str, pattern: str) -> str:
    """SQL: does a value match a pattern in which only * is special?"""
    literal = f"replace(replace(replace({pattern}, '!', '!!'), '%', '!%'), '_', '!_')"
    return f"{value} like replace({literal}, '*', '%') escape '!'"


def _strings(x: str) -> str:
    """SQL: the non-empty strings of a variant that is a string or an array of values."""
    one = f"array(try_variant_get({x}, '$', 'string'))"
    many = f"transform(filter(try_variant_get({x}, '$', 'array<variant>'), e -> schema_of_variant(e) = 'STRING'), e -> variant_get(e, '$', 'string'))"
    return f"filter(case when schema_of_variant({x}) = 'STRING' then {one} when schema_of_variant({x}) like 'ARRAY%' then {many} else array() end, e -> e is not null and e <> '')"


def parsed(policies: DataFrame, text: str = "policy_json") -> DataFrame:
    """policies with ``statements`` (effect, actions, resources, principals, open: names no principal) and ``bad`` (unreadable).

    One statement or an array of them; a single string stands for an array of one. Statements
    without a readable effect say nothing.
    """
    of = lambda f: f"try_variant_get(x, '$.{f}', 'variant')"
    principals = f"if(schema_of_variant({of('Principal')}) = 'STRING', array(variant_get({of('Principal')}, '$', 'string')), coalesce({_strings('try_variant_get(x, ' + chr(39) + '$.Principal.AWS' + chr(39) + ', ' + chr(39) + 'variant' + chr(39) + ')')}, array()))"
    effect = f"if(schema_of_variant({of('Effect')}) = 'STRING', lower(variant_get({of('Effect')}, '$', 'string')), '')"
    read = f"struct({effect} as effect, coalesce({_strings(of('Action'))}, array()) as actions, coalesce({_strings(of('Resource'))}, array()) as resources, {principals} as principals, {of('Principal')} is null as open)"
    rows = policies.withColumn("json", F.expr(f"try_parse_json({text})")).withColumn("bad", F.expr(f"trim({text}) <> '' and json is null"))
    rows = rows.withColumn("json", F.expr("try_variant_get(json, '$.Statement', 'variant')"))
    listed = "case when schema_of_variant(json) like 'ARRAY%' then try_variant_get(json, '$', 'array<variant>') when schema_of_variant(json) like 'OBJECT%' then array(json) end"
    return rows.withColumn("statements", F.expr(f"filter(transform({listed}, x -> {read}), s -> s.effect in ('allow', 'deny'))")).drop("json")


def candidates(bucket: str, key: str) -> str:
    """SQL: the names of what a request is about: the service, a bucket, or an object."""
    return f"""case when coalesce({bucket}, '') = '' then array('arn:aws:s3:::*', '*') when {key} is null then array(concat('arn:aws:s3:::', {bucket}), {bucket})
        else array(concat('arn:aws:s3:::', {bucket}, '/', {key}), concat({bucket}, '/', {key})) end"""


def decision(statements: str, bad: str, action: str, bucket: str, key: str, principal: str, access_key: bool = False) -> Column:
    """Deny before Allow, else Neutral; an unreadable policy denies. A statement that names no principal speaks in access-key policies only."""
    who = f"exists(s.principals, p -> p = '*' or (coalesce({principal}, '') <> '' and p = {principal})) or ({'true' if access_key else 'false'} and s.open)"
    hit = f"exists(s.actions, a -> {glob(action, 'a')}) and ({who}) and exists(s.resources, r -> exists({candidates(bucket, key)}, c -> {glob('c', 'r')}))"
    has = lambda effect: f"coalesce(exists({statements}, s -> s.effect = '{effect}' and {hit}), false)"
    return F.expr(f"case when coalesce({bad}, false) or {has('deny')} then 'Deny' when {has('allow')} then 'Allow' else 'Neutral' end")


def decide(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """requests (bucket, key, action, principal) with ``decision`` by the policy of their bucket (policies: bucket, policy_json)."""
    rows = requests.join(parsed(policies).select("bucket", "statements", "bad"), "bucket", "left")
    return rows.withColumn("decision", decision("statements", "bad", "action", "bucket", "key", "principal")).drop("statements", "bad")


def authorize(requests: DataFrame, policies: DataFrame, keys: DataFrame) -> DataFrame:
    """requests (bucket, key, action, signed, valid, access_key, needs_key) with ``outcome``.

    In this order: a bad signature, the policy of the access key (keys: access_key, key_policy), the
    service without a bucket, the policy of the bucket, and a request without a key.
    """
    asked = requests.withColumn("known", F.expr("signed and valid")).withColumn("principal", F.expr("if(known, access_key, null)"))
    by_key = parsed(keys.filter("trim(key_policy) <> ''"), "key_policy").select(F.col("access_key").alias("principal"), F.col("statements").alias("ks"), F.col("bad").alias("kb"), F.lit(True).alias("kp"))
    rows = asked.join(parsed(policies).select("bucket", "statements", "bad"), "bucket", "left").join(by_key, "principal", "left")
    rows = rows.withColumn("own", decision("ks", "kb", "action", "bucket", "key", "principal", True)).withColumn("theirs", decision("statements", "bad", "action", "bucket", "key", "principal"))
    outcome = """case when signed and not valid then 'bad signature' when kp and own <> 'Allow' then 'denied by key policy'
        when bucket is null then if(known, 'ok', 'key required') when theirs = 'Deny' then 'denied by bucket policy'
        when not known and (needs_key or theirs <> 'Allow') then 'key required' else 'ok' end"""
    return rows.select(*[F.col(c) for c in requests.columns], F.expr(outcome).alias("outcome"))


def valid_bucket(name: str) -> Column:
    return F.expr(f"{name} rlike '^[a-z0-9][a-z0-9.-]{{1,61}}[a-z0-9]$' and not ({name} rlike '[.][.]|[.]-|-[.]') and not ({name} rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$')")


def byte_range(rows: DataFrame, header: str, length: str) -> DataFrame:
    """rows with first_byte and last_byte (inclusive) of a range header; null where it can't be met."""
    a, b = F.expr(f"regexp_extract({header}, '^bytes=([0-9]*)-([0-9]*)$', 1)"), F.expr(f"regexp_extract({header}, '^bytes=([0-9]*)-([0-9]*)$', 2)")
    rows = rows.withColumn("_a", a.try_cast("long")).withColumn("_b", b.try_cast("long"))
    first = F.expr(f"case when _a is not null then _a when _b is not null then greatest(0, {length} - _b) end")
    last = F.expr(f"case when _a is null then {length} - 1 when _b is null then {length} - 1 else least(_b, {length} - 1) end")
    rows = rows.withColumn("_f", first).withColumn("_l", last)
    ok = F.expr(f"_f is not null and _f <= _l and _f < {length}")
    return rows.withColumn("first_byte", F.when(ok, F.col("_f"))).withColumn("last_byte", F.when(ok, F.col("_l"))).drop("_a", "_b", "_f", "_l")


def address(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with host, bucket and key of a path-style address."""
    path = F.expr(f"regexp_extract({url}, '^[a-z]+://[^/]+/(.*)$', 1)")
    rows = urls.withColumn("host", F.expr(f"regexp_extract({url}, '^[a-z]+://([^/]+)', 1)")).withColumn("_p", path)
    return rows.withColumn("bucket", F.expr("substring_index(_p, '/', 1)")).withColumn("key", F.expr("case when instr(_p, '/') > 0 then substr(_p, instr(_p, '/') + 1) else '' end")).drop("_p")
