"""Rules over policy statements.

Statements are found by their place under the policy property of a resource's type; the branches of conditions in them are
places too, so no recursion is needed. Values become candidates; those that can't be known block a verdict instead of
deciding it, and a parameter's allowed values decide only together.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.logic import wildcard
from siltstone.plans.settle import settled
from siltstone.rules.network import row
from siltstone.sources.templates import Relations

# Where policies stand, as "type: property", with the kind of policy.
SITES = (
    ("AWS::IAM::Role", "Properties/AssumeRolePolicyDocument", "trust"),
    ("AWS::IAM::Role", "Properties/Policies/*/PolicyDocument", "inline"),
    ("AWS::IAM::User", "Properties/Policies/*/PolicyDocument", "inline"),
    ("AWS::IAM::Group", "Properties/Policies/*/PolicyDocument", "inline"),
    ("AWS::IAM::ManagedPolicy", "Properties/PolicyDocument", "managed"),
    ("AWS::IAM::Policy", "Properties/PolicyDocument", "managed"),
    ("AWS::S3::BucketPolicy", "Properties/PolicyDocument", "resource"),
    ("AWS::KMS::Key", "Properties/KeyPolicy", "resource"),
    ("AWS::SQS::QueuePolicy", "Properties/PolicyDocument", "resource"),
    ("AWS::SNS::TopicPolicy", "Properties/PolicyDocument", "resource"),
    ("AWS::ECR::Repository", "Properties/RepositoryPolicyText", "resource"),
    ("AWS::SecretsManager::ResourcePolicy", "Properties/ResourcePolicy", "resource"),
    ("AWS::Lambda::Permission", "Properties", "permission"),
)
# Properties of a permission that bound it, and the keys of a condition that say the same.
PERMISSION_KEYS = (("SourceAccount", "aws:SourceAccount"), ("SourceArn", "aws:SourceArn"), ("PrincipalOrgID", "aws:PrincipalOrgID"))
# Actions and keys that the rules speak of.
MUTATING = (
    "iam:CreatePolicyVersion",
    "iam:SetDefaultPolicyVersion",
    "iam:AttachUserPolicy",
    "iam:AttachGroupPolicy",
    "iam:AttachRolePolicy",
    "iam:PutUserPolicy",
    "iam:PutGroupPolicy",
    "iam:PutRolePolicy",
)
S3_ALL = ("s3:GetObject", "s3:PutObject", "s3:DeleteObject")
SENSITIVE = ("iam:", "sts:", "lambda:", "s3:")
DEPUTY_KEYS = ("aws:sourceaccount", "aws:sourcearn", "aws:principalorgid")
_ACTIONS = {"passrole": "iam:PassRole", "assumerole": "sts:AssumeRole", "create_fn": "lambda:CreateFunction", "update_fn": "lambda:UpdateFunctionCode", "invoke_fn": "lambda:InvokeFunction", "run_ec2": "ec2:RunInstances", **{f"s3_{i}": a for i, a in enumerate(S3_ALL)}}
_STEP = r"(?:/[0-9]+|/Fn::If/[12])*"


def _props(relations: Relations) -> DataFrame:
    """The properties that tell statements, with the type of their resource; a permission's stand as one statement that allows."""
    prop = F.col("prop")
    bounds = [F.startswith(prop, F.lit(f"Properties/{name}")) for name in ("Action", "Principal", *dict(PERMISSION_KEYS))]
    told = relations.props.where(reduce(Column.__or__, bounds, F.contains(prop, F.lit("/Statement")) | (prop == "Properties")))
    kinds = relations.resources.where(F.col("type").isin(*{t for t, *_ in SITES})).select("template_id", "logical_id", "type")
    own = told.select("template_id", "logical_id", "vtype", "sval", "place", "prop").join(kinds, ["template_id", "logical_id"])
    is_permission = F.col("type") == "AWS::Lambda::Permission"
    moves = [("^Properties/(Action|Principal)(?=/|$)", "Properties/Statement/$1"), ("^Properties$", "Properties/Statement")]
    moves += [(f"^Properties/{name}(?=/|$)", f"Properties/Statement/Condition/Bound/{key}") for name, key in PERMISSION_KEYS]

    def said(column: str) -> Column:
        moved = F.col(column)
        for pattern, to in moves:
            moved = F.regexp_replace(moved, pattern, to)
        return F.when(is_permission, moved).otherwise(F.col(column)).alias(column)

    own = own.select("template_id", "logical_id", "type", "vtype", "sval", said("place"), said("prop"))
    effect = F.lit("Properties/Statement/Effect")
    allows = own.where(is_permission & (F.col("place") == "Properties/Statement")).withColumns({"vtype": F.lit("str"), "sval": F.lit("Allow"), "place": effect, "prop": effect})
    return own.unionByName(allows)


def _roots(props: DataFrame) -> DataFrame:
    """(template_id, logical_id, kind, doc, stmt): where statements stand."""
    sites = F.broadcast(props.sparkSession.createDataFrame(SITES, "type string, site string, kind string"))
    maps = props.where("vtype = 'map'").join(sites, "type")
    shape = F.regexp_replace("prop", r"/Fn::If/\*", "")
    doc = F.regexp_extract("place", r"^(.*)/Statement" + _STEP + "$", 1)
    found = maps.withColumn("doc", doc).where((F.col("doc") != "") & shape.rlike(r"/Statement(/\*)*$") & (F.regexp_replace(shape, r"/Statement(/\*)*$", "") == F.col("site")))
    return found.select("template_id", "logical_id", "kind", "doc", F.col("place").alias("stmt"))


def _effects(props: DataFrame) -> DataFrame:
    """(template_id, logical_id, stmt, effect)."""
    return props.where(F.col("place").endswith("/Effect")).select("template_id", "logical_id", F.regexp_replace("place", "/Effect$", "").alias("stmt"), F.lower(F.trim("sval")).alias("effect"))


def statements(relations: Relations) -> DataFrame:
    """(template_id, logical_id, kind, doc, stmt, effect): doc and stmt are places; one row a statement and branch. A statement
    that tells no effect has none, and is no detector's."""
    props = _props(relations)
    return _roots(props).join(_effects(props), ["template_id", "logical_id", "stmt"], "left")


def _candidates(relations: Relations, props: DataFrame) -> DataFrame:
    """(template_id, logical_id, stmt, element, grp, all_required, text, blocked): text is null where a value is unknown."""
    at = F.regexp_extract("place", r"^(.*?/Statement" + _STEP + r")/(Action|Resource|Principal|Condition)(/.*)?$", 1)
    element = F.regexp_extract("place", r"/Statement" + _STEP + r"/(Action|Resource|Principal)(/.*)?$", 1)
    rest = F.regexp_extract("place", r"/Statement" + _STEP + r"/(?:Action|Resource|Principal)(/.*)?$", 1)
    rows = props.where("vtype not in ('map', 'list')").select("template_id", "logical_id", at.alias("stmt"), element.alias("element"), rest.alias("rest"), "place", "sval").where("stmt != '' and element != ''")
    plain = F.regexp_replace("rest", r"/[0-9]+|/Fn::If/[12]", "")
    plain = F.when(F.col("element") == "Principal", F.regexp_replace(plain, r"^/(AWS|Service|Federated|CanonicalUser)", "")).otherwise(plain)
    rows = rows.withColumn("plain", plain).where(~F.col("rest").rlike(r"/Fn::If/0$"))
    values = relations.nodes.where("get(path, 0) = 'Parameters' and size(path) = 4 and get(path, 2) = 'AllowedValues'").select("template_id", F.get("path", F.lit(1)).alias("sval"), F.col("sval").alias("allowed"))
    is_ref, pseudo = F.col("plain") == "/Ref", F.col("sval").startswith("AWS::")
    fixed = rows.where((F.col("plain") == "") | (F.col("plain") == "/Fn::Sub") | (is_ref & pseudo & (F.col("sval") != "AWS::NoValue")))
    unknown = (F.col("plain") == "/Fn::Sub") & F.col("sval").rlike(r"\$\{(?!AWS::|!)[^}]*\}")
    key = ["template_id", "logical_id", "stmt", "element"]
    one = fixed.select(*key, F.col("place").alias("grp"), F.lit(False).alias("all_required"), F.when(is_ref, F.concat(F.lit("${"), "sval", F.lit("}"))).otherwise(F.col("sval")).alias("text"), unknown.alias("blocked"))
    params = rows.where(is_ref & ~pseudo).join(values, ["template_id", "sval"], "left")
    two = params.select(*key, F.col("place").alias("grp"), F.col("allowed").isNotNull().alias("all_required"), F.col("allowed").alias("text"), F.col("allowed").isNull().alias("blocked"))
    others = rows.where((F.col("plain") != "") & ~is_ref & (F.col("plain") != "/Fn::Sub"))
    three = others.select(*key, F.regexp_extract("place", r"^(.*?/Fn::(?!If)[A-Za-z0-9]+)", 1).alias("grp"), F.lit(False).alias("all_required"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("blocked"))
    return one.unionByName(two).unionByName(three)


def principal_class(text: Column) -> Column:
    """star, service, same_account, cross_account or unresolvable."""
    account = F.coalesce(F.nullif(F.regexp_extract(text, r"^arn:[^:]*:[^:]*:[^:]*:([0-9]{12}):", 1), F.lit("")), F.when(text.rlike(r"^[0-9]{12}\z"), text))
    return F.when(text == "*", "star").when(text.endswith(".amazonaws.com"), "service").when(account.isNotNull(), "cross_account").when(F.contains(text, F.lit("${AWS::AccountId}")), "same_account").otherwise("unresolvable")


def _flags() -> dict[str, dict[str, Column]]:
    """What a candidate of an element may say, by name; a flag's name begins with its element's letter."""
    text = F.col("text")
    plain = ~(F.contains(text, F.lit("*")) | F.contains(text, F.lit("?")))
    grants = lambda action: F.when(plain, F.lower(text) == action.lower()).otherwise(F.rlike(F.lit(action.lower()), wildcard(text)))
    actions = {"a_star": text == "*", "a_wild": F.contains(text, F.lit("*")), "a_sensitive": F.lower(text).rlike("^(" + "|".join(SENSITIVE) + ")"), "a_mutates": F.greatest(*[grants(a) for a in MUTATING])}
    actions |= {f"a_{n}": grants(a) for n, a in _ACTIONS.items()}
    wild = F.contains(text, F.lit("*"))
    resources = {"r_star": text == "*", "r_wild": wild, "r_role": (text == "*") | F.contains(text, F.lit(":role/")) & wild}
    return {"Action": actions, "Resource": resources, "Principal": {f"p_{c}": principal_class(text) == c for c in ("star", "service", "cross_account")}}


#: Rows of policies that a task groups.
TASK_ROWS = 100_000


def judged(relations: Relations) -> DataFrame:
    """Statements that allow, with a flag for each thing they surely say, their condition keys, and whether a value is unknown.

    All that is told of a statement is grouped at once by tasks of about TASK_ROWS rows of policies: flags as bits of a number.
    """
    props = settled(_props(relations))
    flags = _flags()
    bit = {n: 1 << i for i, n in enumerate(n for of in flags.values() for n in of)}
    said = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for element, of in flags.items():
        said = said.when(F.col("element") == element, reduce(Column.__add__, [F.when(hit, F.lit(bit[n]).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for n, hit in of.items()]))
    key = ["template_id", "logical_id", "stmt"]
    cands = _candidates(relations, props).select(*key, "element", "grp", "all_required", "blocked", said.alias("said"))
    keys = props.select("template_id", "logical_id", F.regexp_extract("place", r"^(.*?/Statement" + _STEP + r")/Condition/", 1).alias("stmt"), F.lower(F.regexp_extract("place", r"/Condition/(?:Fn::If/[12]/)?[^/]+/([^/]+(?:/[^/0-9][^/]*)?)", 1)).alias("k")).where("stmt != '' and k != ''")
    told = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (cands, _roots(props), _effects(props), keys))
    told = told.repartition(math.ceil(props.count() / TASK_ROWS) or 1, "template_id", "logical_id")
    groups = told.groupBy(*key, "element", "grp").agg(
        *[F.max(c).alias(c) for c in ("kind", "doc", "effect")], F.collect_set("k").alias("keys"),
        F.bool_and("all_required").alias("all"), F.bool_or("blocked").alias("blocked"), F.bit_or("said").alias("any"), F.bit_and("said").alias("every"),
    )
    # a group that must agree and does not is unknown; what is no candidate's stands in a group without an element
    torn, cand = F.col("all") & (F.col("any") != F.col("every")), F.col("element").isNotNull()
    decided = groups.groupBy(*key).agg(
        *[F.max(c).alias(c) for c in ("kind", "doc", "effect")], F.coalesce(F.max(F.when(~cand, F.col("keys"))), F.array().cast("array<string>")).alias("keys"),
        F.bool_or(cand).alias("cands"), F.bool_or(F.when(cand, F.col("blocked") | torn)).alias("blocked"), F.bit_or(F.when(cand, F.when(F.col("all"), F.col("every")).otherwise(F.col("any")))).alias("said"),
    )
    allowing = decided.where("kind is not null and effect = 'allow' and cands")
    return allowing.select(*key, "kind", "doc", "effect", "keys", "blocked", *[((F.col("said").bitwiseAND(b)) != 0).alias(n) for n, b in bit.items()])


def _found(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """A finding for each of the rules (name, severity, when, text, type) that holds of a row; the rows are read once."""
    hits = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(text).alias("text"), F.lit(kind).alias("type"))) for rule, severity, hit, text, kind in rules]))
    each = df.select("template_id", "logical_id", "stmt", F.explode(hits).alias("hit"))
    text = F.concat("logical_id", F.lit(" "), "stmt", F.lit(": "), "hit.text")
    return each.select(*row(F.col("hit.rule"), F.col("hit.severity"), "IAM", F.col("hit.type"), "IAM Review", text))


def findings(relations: Relations) -> DataFrame:
    """Findings of all detectors; a cross-account grant with an external id is a level milder."""
    s = settled(judged(relations))
    c, no_keys = F.col, F.size("keys") == 0
    policy = c("kind") != "permission"  # a permission is no policy statement: only what speaks of principals reads it
    deputy = F.exists("keys", lambda k: F.exists(F.array(*map(F.lit, DEPUTY_KEYS)), lambda d: F.startswith(k, d)))
    external = F.exists("keys", lambda k: F.startswith(k, F.lit("sts:externalid")))
    rules = [
        ("star_action_star_resource", "CRITICAL", policy & c("a_star") & c("r_star"), "allows every action on every resource"),
        ("wildcard_action", "HIGH", policy & c("a_wild"), "allows actions by wildcard"),
        ("wildcard_resource", "HIGH", policy & c("r_wild"), "allows resources by wildcard"),
        ("sensitive_prefix_without_condition", "HIGH", policy & c("a_sensitive") & no_keys, "allows sensitive actions without a condition"),
        ("passrole_unrestricted", "CRITICAL", policy & c("a_passrole") & c("r_role"), "lets any role be passed"),
        ("assumerole_unrestricted", "HIGH", policy & c("a_assumerole") & c("r_star"), "lets any role be assumed"),
        ("privesc_policy_mutation", "CRITICAL", policy & c("a_mutates"), "lets policies be changed"),
        ("cross_service_missing_condition", "HIGH", (c("p_service") | c("p_cross_account")) & ~deputy, "trusts a service or account without naming its source"),
        ("principal_star", "CRITICAL", c("p_star"), "trusts everyone"),
    ]
    foreign, broad = c("p_cross_account"), (c("kind") == "trust") & c("a_assumerole")
    rules += [("cross_account_principal", "HIGH", foreign & ~external, "trusts another account"), ("cross_account_principal", "MEDIUM", foreign & external, "trusts another account with an external id")]
    rules += [("privesc_broad_trust", "CRITICAL", broad & c("p_star"), "may be assumed by anyone"), ("privesc_broad_trust", "HIGH", broad & ~c("p_star") & c("p_service") & no_keys, "may be assumed by a service without a condition")]
    # pairs and triples of actions that one document grants
    by_doc = s.where(policy).groupBy("template_id", "logical_id", "doc")
    flags = by_doc.agg(*[F.bool_or(f"a_{n}").alias(n) for n in _ACTIONS], *[F.bool_or(c(f"a_s3_{i}") & c("r_star")).alias(f"any_{i}") for i in range(3)], F.min("stmt").alias("stmt"))
    combos = [
        ("privesc_lambda_passrole", "CRITICAL", "passrole and create_fn", "may pass a role to a new function"),
        ("dangerous_s3_combo", "HIGH", "any_0 and any_1 and any_2", "may read, write and delete all objects"),
        ("dangerous_ec2_passrole", "HIGH", "passrole and run_ec2", "may pass a role to a new instance"),
        ("dangerous_lambda_combo", "HIGH", "update_fn and invoke_fn", "may change a function's code and call it"),
    ]
    rules = [(*r, "Security") for r in rules] + [("unresolvable_value", "INFO", c("blocked"), "has values that are not known before deployment", "Informational")]
    return _found(s, rules).unionByName(_found(flags, [(rule, severity, F.expr(hit), text, "Security") for rule, severity, hit, text in combos]))
