"""The review over templates made from the tables: rules, merge, numbering and counts, each with DuckDB SQL of its own.

The SQL reads the same texts with DuckDB's JSON functions and states each rule anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import facts, semantic
from siltstone.plans.settle import settled
from siltstone.review import Review
from siltstone.rules import findings
from siltstone.sources import made
from siltstone.sources.templates import Relations, nodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_COLUMNS = ("template_id", "resource", "rule_id", "severity", "category", "type")


def sql(oracle: str):  # noqa: ANN201
    """Registers a query with its SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, oracle
        return f

    return add


def _raw(spark: SparkSession, sf_dir: str, kind: str, *sources: str) -> DataFrame:
    return Review(made.templates(spark, sf_dir, kind), sources).raw().select(*_COLUMNS).distinct()


# Property rules: for each rule its resource type, when it fails, severity, category, finding type.
_missing = lambda p: f"json_extract(j, '$.Properties.{p}') IS NULL"
_not = lambda p, v: f"coalesce(CAST(json_extract(j, '$.Properties.{p}') AS VARCHAR) <> '{v}', true)"
_true = lambda p: _not(p, "true")
_outside = lambda p, *v: f"coalesce(json_extract_string(j, '$.Properties.{p}') NOT IN ({', '.join(map(repr, v))}), true)"
_has = lambda p, v: f"list_contains(json_extract_string(j, '$.Properties.{p}'), '{v}')"
_SEC, _BEST = "Security", "BestPractice"
_TAGGED = "S3::Bucket RDS::DBInstance EC2::Instance EC2::SecurityGroup EC2::Volume DynamoDB::Table Lambda::Function SNS::Topic SQS::Queue EC2::VPC EC2::Subnet".split()
_PUBLIC = [f"NOT {_missing('PublicAccessBlockConfiguration')} AND {_true('PublicAccessBlockConfiguration.' + x)}" for x in ("BlockPublicAcls", "BlockPublicPolicy", "IgnorePublicAcls", "RestrictPublicBuckets")]
_STATEMENT = "len(list_filter(json_extract(j, '$.Properties.PolicyDocument.Statement[*]'), lambda s: json_extract_string(s, '$.Effect') = 'Allow' AND {} AND {})) > 0".format(
    *[f"(coalesce(json_type(s, '$.{x}') = 'VARCHAR' AND json_extract_string(s, '$.{x}') = '*', false) OR coalesce(list_contains(json_extract_string(s, '$.{x}[*]'), '*'), false))" for x in ("Action", "Resource")]
)
_RULES = [
    ("s3_bucket_encryption", "S3::Bucket", _missing("BucketEncryption"), "HIGH", "Encryption", _SEC),
    ("rds_storage_encrypted", "RDS::DBInstance", _true("StorageEncrypted"), "HIGH", "Encryption", _SEC),
    ("ebs_volume_encrypted", "EC2::Instance", "coalesce(json_array_length(j, '$.Properties.BlockDeviceMappings'), 0) = 0 OR len(list_filter(json_extract(j, '$.Properties.BlockDeviceMappings[*]'), lambda x: coalesce(CAST(json_extract(x, '$.Ebs.Encrypted') AS VARCHAR) <> 'true', true))) > 0", "HIGH", "Encryption", _SEC),
    ("sns_topic_encrypted", "SNS::Topic", _missing("KmsMasterKeyId"), "MEDIUM", "Encryption", _SEC),
    ("logs_group_encrypted", "Logs::LogGroup", _missing("KmsKeyId"), "MEDIUM", "Encryption", _SEC),
    ("sqs_queue_encrypted", "SQS::Queue", _missing("KmsMasterKeyId"), "MEDIUM", "Encryption", _SEC),
    ("dynamodb_encryption", "DynamoDB::Table", f"{_missing('SSESpecification')} OR {_true('SSESpecification.SSEEnabled')}", "MEDIUM", "Encryption", _SEC),
    ("kinesis_encryption", "Kinesis::Stream", f"{_missing('StreamEncryption')} OR {_outside('StreamEncryption.EncryptionType', 'KMS')}", "HIGH", "Encryption", _SEC),
    ("redshift_encryption", "Redshift::Cluster", _true("Encrypted"), "HIGH", "Encryption", _SEC),
    ("elasticache_encryption", "ElastiCache::ReplicationGroup", f"{_true('TransitEncryptionEnabled')} OR {_true('AtRestEncryptionEnabled')}", "HIGH", "Encryption", _SEC),
    ("efs_encryption", "EFS::FileSystem", _true("Encrypted"), "HIGH", "Encryption", _SEC),
    *[("iam_policy_no_star_star", t, _STATEMENT, "CRITICAL", "IAM", _SEC) for t in ("IAM::Policy", "IAM::ManagedPolicy")],
    ("s3_access_logging", "S3::Bucket", _missing("LoggingConfiguration"), "MEDIUM", "Logging", _SEC),
    ("cloudtrail_enabled", "CloudTrail::Trail", f"{_true('IsLogging')} OR {_true('EnableLogFileValidation')}", "HIGH", "Logging", _SEC),
    ("logs_retention_set", "Logs::LogGroup", _missing("RetentionInDays"), "LOW", "Logging", _SEC),
    ("alb_access_logging", "ElasticLoadBalancingV2::LoadBalancer", _missing("LoadBalancerAttributes"), "MEDIUM", "Logging", _SEC),
    ("vpc_flow_logs", "EC2::VPC", "template_id NOT IN (SELECT template_id FROM t WHERE rtype = 'AWS::EC2::FlowLog')", "MEDIUM", "NetworkSecurity", _SEC),
    ("vpc_dns_hostnames", "EC2::VPC", _true("EnableDnsHostnames"), "MEDIUM", "NetworkSecurity", _BEST),
    ("s3_public_access_block", "S3::Bucket", " OR ".join([_missing("PublicAccessBlockConfiguration"), *_PUBLIC]), "CRITICAL", "PublicAccess", _SEC),
    ("security_group_open_ingress", "EC2::SecurityGroup", f"coalesce({_has('SecurityGroupIngress[*].CidrIp', '0.0.0.0/0')}, false) OR coalesce({_has('SecurityGroupIngress[*].CidrIpv6', '::/0')}, false)", "HIGH", "NetworkSecurity", _SEC),
    ("rds_publicly_accessible", "RDS::DBInstance", f"NOT {_missing('PubliclyAccessible')} AND {_not('PubliclyAccessible', 'false')}", "CRITICAL", "PublicAccess", _SEC),
    ("ec2_imdsv2_required", "EC2::Instance", f"{_missing('MetadataOptions')} OR {_outside('MetadataOptions.HttpTokens', 'required')}", "HIGH", "DataProtection", _SEC),
    ("alb_https_only", "ElasticLoadBalancingV2::Listener", f"json_extract_string(j, '$.Properties.Protocol') = 'HTTP' AND {_outside('DefaultActions[0].Type', 'redirect')}", "HIGH", "PublicAccess", _SEC),
    ("cloudfront_https", "CloudFront::Distribution", _outside("DistributionConfig.DefaultCacheBehavior.ViewerProtocolPolicy", "https-only", "redirect-to-https"), "HIGH", "PublicAccess", _SEC),
    ("rds_backup_retention", "RDS::DBInstance", f"{_missing('BackupRetentionPeriod')} OR json_type(j, '$.Properties.BackupRetentionPeriod') NOT IN ('UBIGINT', 'BIGINT') OR TRY_CAST(json_extract_string(j, '$.Properties.BackupRetentionPeriod') AS DOUBLE) < 7", "MEDIUM", "Backup", _BEST),
    ("rds_deletion_protection", "RDS::DBInstance", _true("DeletionProtection"), "HIGH", "Availability", _BEST),
    ("rds_multi_az", "RDS::DBInstance", _true("MultiAZ"), "MEDIUM", "Availability", _BEST),
    ("s3_deletion_policy", "S3::Bucket", "json_extract(j, '$.DeletionPolicy') IS NULL", "HIGH", "Backup", _BEST),
    ("s3_versioning_enabled", "S3::Bucket", _outside("VersioningConfiguration.Status", "Enabled"), "MEDIUM", "DataProtection", _BEST),
    ("dynamodb_pitr", "DynamoDB::Table", f"{_missing('PointInTimeRecoverySpecification')} OR {_true('PointInTimeRecoverySpecification.PointInTimeRecoveryEnabled')}", "MEDIUM", "DataProtection", _BEST),
    ("lambda_dlq", "Lambda::Function", _missing("DeadLetterConfig"), "MEDIUM", "Availability", _BEST),
    ("lambda_timeout", "Lambda::Function", _missing("Timeout"), "LOW", "Availability", _BEST),
    ("asg_multi_az", "AutoScaling::AutoScalingGroup", "coalesce(json_array_length(j, '$.Properties.AvailabilityZones'), 0) < 2", "MEDIUM", "Availability", _BEST),
    ("ec2_ebs_optimized", "EC2::Instance", _true("EbsOptimized"), "LOW", "Availability", _BEST),
    *[("required_tags", t, f"{_missing('Tags')} OR NOT coalesce({_has('Tags[*].Key', 'Environment')}, false) OR NOT coalesce({_has('Tags[*].Key', 'Owner')}, false)", "LOW", "Tagging", _BEST) for t in _TAGGED],
]
_PARTS = f"t AS (SELECT template_id, resource, body::JSON AS j, json_extract_string(body, '$.Type') AS rtype FROM ({made.sql('parts')}))"
_PROPERTY = " UNION ALL ".join(f"SELECT template_id, resource, '{r}' AS rule_id, '{s}' AS severity, '{c}' AS category, '{k}' AS type FROM t WHERE rtype = 'AWS::{t}' AND ({cond})" for r, t, cond, s, c, k in _RULES)


@sql(f"WITH {_PARTS} SELECT * FROM ({_PROPERTY})")
def review_property_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules over properties, over templates of parts."""
    return _raw(spark, sf_dir, "parts", "properties")


# Policies: a statement's elements as groups of candidates, of which any may decide, or all of a parameter's values must.
def _groups(value: str) -> str:
    return f"""list_transform(CASE WHEN {value} IS NULL THEN [] WHEN json_type({value}) = 'ARRAY' THEN json_extract({value}, '$[*]') ELSE [{value}] END,
      lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN [json_extract_string(x, '$')] WHEN starts_with(json_extract_string(x, '$.Ref'), 'AWS::') THEN ['${{' || (json_extract_string(x, '$.Ref')) || '}}']
      ELSE list_filter([json_extract_string(body, '$.Parameters.' || (json_extract_string(x, '$.Ref')) || '.AllowedValues[' || i || ']') FOR i IN range(2)], lambda y: y IS NOT NULL) END)"""


def _decided(groups: str, pred: str) -> str:
    return f"(len(list_filter({groups}, lambda g: len(g) > 0 AND len(list_filter(g, lambda x: NOT ({pred}))) = 0)) > 0)"


def _torn(groups: str, pred: str) -> str:
    return f"(len(list_filter({groups}, lambda g: len(g) > 1 AND len(list_filter(g, lambda x: {pred})) BETWEEN 1 AND len(g) - 1)) > 0)"


def _grants(action: str) -> str:
    return rf"regexp_full_match('{action.lower()}', replace(replace(regexp_escape(lower(x)), '\*', '.*'), '\?', '.'))"


_MUTATING = "CreatePolicyVersion SetDefaultPolicyVersion AttachUserPolicy AttachGroupPolicy AttachRolePolicy PutUserPolicy PutGroupPolicy PutRolePolicy".split()
_ACTION = {
    "a_star": "x = '*'", "a_wild": "contains(x, '*')", "a_sensitive": "regexp_matches(lower(x), '^(iam:|sts:|lambda:|s3:)')", "a_mutates": " OR ".join(_grants(f"iam:{a}") for a in _MUTATING),
    **{f"g_{a.split(':')[1]}": _grants(a) for a in ("iam:PassRole", "sts:AssumeRole", "lambda:CreateFunction", "lambda:UpdateFunctionCode", "lambda:InvokeFunction", "ec2:RunInstances", "s3:GetObject", "s3:PutObject", "s3:DeleteObject")},
}
_RESOURCE = {"r_star": "x = '*'", "r_wild": "contains(x, '*')", "r_role": "x = '*' OR contains(x, ':role/') AND contains(x, '*')"}
_PRINCIPAL = {"p_star": "x = '*'", "p_service": "ends_with(x, '.amazonaws.com')", "p_cross": "regexp_full_match(x, '[0-9]{12}') OR regexp_matches(x, '^arn:[^:]*:[^:]*:[^:]*:[0-9]{12}:')"}
_FLAGS = ", ".join([f"{_decided('ga', p)} AS {n}" for n, p in _ACTION.items()] + [f"{_decided('gr', p)} AS {n}" for n, p in _RESOURCE.items()] + [f"{_decided('gp', p)} AS {n}" for n, p in _PRINCIPAL.items()])
_UNKNOWN = " OR ".join([f"list_contains(list_transform({g}, lambda g: len(g)), 0)" for g in ("ga", "gr", "gp")] + [_torn("ga", p) for p in _ACTION.values()] + [_torn("gr", p) for p in _RESOURCE.values()])
_POLICY = f"""t AS ({made.sql('policies')}),
 node AS (SELECT template_id, body, n.fullkey, n.value, n.type AS vtype FROM t, json_tree(t.body::JSON) n),
 stmt AS (SELECT template_id, body, CASE WHEN contains(fullkey, 'AssumeRole') THEN 'trust' ELSE 'policy' END AS kind, regexp_extract(fullkey, '^(.*)\\.Statement', 1) AS doc, value AS s
   FROM node WHERE vtype = 'OBJECT' AND regexp_matches(fullkey, 'PolicyDocument\\.Statement(\\[[0-9]+\\])?$')
   UNION ALL SELECT template_id, body, 'permission', '$', json_object('Effect', 'Allow', 'Action', json_extract(value, '$.Action'), 'Principal', json_extract(value, '$.Principal'), 'Condition',
     CASE WHEN json_extract(value, '$.SourceAccount') IS NOT NULL THEN json_object('b', json_object('aws:SourceAccount', 1)) WHEN json_extract(value, '$.PrincipalOrgID') IS NOT NULL THEN json_object('b', json_object('aws:PrincipalOrgID', 1)) END)
   FROM node WHERE fullkey = '$.Resources.It.Properties' AND json_extract_string(body, '$.Resources.It.Type') = 'AWS::Lambda::Permission'),
 el AS (SELECT template_id, kind, doc, CASE WHEN json_extract(s, '$.Condition') IS NOT NULL AND json_type(json_extract(s, '$.Condition')) <> 'NULL' THEN lower(CAST(json_extract(s, '$.Condition') AS VARCHAR)) END AS cond, {_groups("(json_extract(s, '$.Action'))")} AS ga, {_groups("(json_extract(s, '$.Resource'))")} AS gr,
   CASE WHEN json_type(json_extract(s, '$.Principal')) = 'OBJECT' THEN {_groups("coalesce(json_extract(s, '$.Principal.AWS'), json_extract(s, '$.Principal.Service'), json_extract(s, '$.Principal.CanonicalUser'))")} ELSE {_groups("(json_extract(s, '$.Principal'))")} END AS gp
   FROM stmt WHERE lower(trim(json_extract_string(s, '$.Effect'))) = 'allow'),
 f AS (SELECT template_id, kind, doc, cond, kind <> 'permission' AS pol, {_FLAGS}, ({_UNKNOWN}) AS unknown FROM el),
 d AS (SELECT template_id, doc, bool_or(g_PassRole) AS pass, bool_or(g_CreateFunction) AS makes, bool_or(g_UpdateFunctionCode) AS changes, bool_or(g_InvokeFunction) AS calls, bool_or(g_RunInstances) AS runs,
   bool_or(g_GetObject AND r_star) AND bool_or(g_PutObject AND r_star) AND bool_or(g_DeleteObject AND r_star) AS all_s3 FROM f WHERE pol GROUP BY template_id, doc),
 e(template_id, rule_id, severity, type) AS """
_BOUND = "regexp_matches(coalesce(cond, ''), '\"aws:(sourceaccount|sourcearn|principalorgid)')"
_DETECTED = [
    ("star_action_star_resource", "CRITICAL", "f", "pol AND a_star AND r_star"),
    ("wildcard_action", "HIGH", "f", "pol AND a_wild"),
    ("wildcard_resource", "HIGH", "f", "pol AND r_wild"),
    ("sensitive_prefix_without_condition", "HIGH", "f", "pol AND a_sensitive AND cond IS NULL"),
    ("passrole_unrestricted", "CRITICAL", "f", "pol AND g_PassRole AND r_role"),
    ("assumerole_unrestricted", "HIGH", "f", "pol AND g_AssumeRole AND r_star"),
    ("privesc_policy_mutation", "CRITICAL", "f", "pol AND a_mutates"),
    ("privesc_lambda_passrole", "CRITICAL", "d", "pass AND makes"),
    ("privesc_broad_trust", "CRITICAL", "f", "kind = 'trust' AND g_AssumeRole AND p_star"),
    ("privesc_broad_trust", "HIGH", "f", "kind = 'trust' AND g_AssumeRole AND NOT p_star AND p_service AND cond IS NULL"),
    ("cross_service_missing_condition", "HIGH", "f", f"(p_service OR p_cross) AND NOT {_BOUND}"),
    ("cross_account_principal", "HIGH", "f", "p_cross AND NOT contains(coalesce(cond, ''), '\"sts:externalid')"),
    ("cross_account_principal", "MEDIUM", "f", "p_cross AND contains(coalesce(cond, ''), '\"sts:externalid')"),
    ("principal_star", "CRITICAL", "f", "p_star"),
    ("dangerous_s3_combo", "HIGH", "d", "all_s3"),
    ("dangerous_ec2_passrole", "HIGH", "d", "pass AND runs"),
    ("dangerous_lambda_combo", "HIGH", "d", "changes AND calls"),
]
_FOUND = " UNION ALL ".join([f"SELECT template_id, '{r}', '{s}', 'Security' FROM {src} WHERE {cond}" for r, s, src, cond in _DETECTED] + ["SELECT template_id, 'unresolvable_value', 'INFO', 'Informational' FROM f WHERE unknown"])


@sql(f"WITH {_POLICY}({_FOUND}) SELECT DISTINCT template_id, 'It' AS resource, rule_id, severity, 'IAM' AS category, type FROM e")
def review_policy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all detectors over policies, three-valued where values are not known."""
    return _raw(spark, sf_dir, "policies", "iam")


# Graphs of whole templates.
_WHOLE = f"""t AS ({made.sql('templates')}),
 node AS (SELECT template_id, n.id, n.key, n.path, n.fullkey, n.type AS vtype, CASE WHEN n.type = 'VARCHAR' THEN json_extract_string(n.value, '$') ELSE CAST(n.value AS VARCHAR) END AS v FROM t, json_tree(t.body::JSON) n),
 res AS (SELECT template_id, key AS name, id, fullkey FROM node WHERE path = '$.Resources'),
 kind AS (SELECT r.template_id, r.name, n.v AS rtype FROM res r JOIN node n ON n.template_id = r.template_id AND n.path = r.fullkey AND n.key = 'Type'),
 ends AS (SELECT template_id, regexp_extract(fullkey, '^\\$\\.Resources\\.([A-Za-z0-9]+)', 1) AS src, split_part(v, '.', CASE WHEN contains(fullkey, 'GetAtt') THEN 1 ELSE 1 END) AS dst, (fullkey LIKE '%.DependsOn%')::INT AS late, id FROM node
   WHERE vtype = 'VARCHAR' AND (regexp_matches(fullkey, '^\\$\\.Resources\\.[A-Za-z0-9]+\\.Properties\\..*(\\.Ref|"Fn::GetAtt"(\\[0\\])?)$') OR regexp_matches(fullkey, '^\\$\\.Resources\\.[A-Za-z0-9]+\\.DependsOn(\\[[0-9]+\\])?$'))),
 edge AS (SELECT e.template_id, src, dst, min((late, e.id)) AS rank FROM ends e JOIN res r ON r.template_id = e.template_id AND r.name = e.dst WHERE src <> dst GROUP BY ALL)"""


@sql(f"WITH {_WHOLE} SELECT template_id, src, dst FROM edge")
def review_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between the resources of a template."""
    return Relations(settled(nodes(made.templates(spark, sf_dir, "templates")))).edges()


_NETWORK = {
    "igw_not_attached": ("HIGH", "rtype = 'AWS::EC2::InternetGateway' AND NOT EXISTS (FROM edge e JOIN kind s ON s.template_id = e.template_id AND s.name = e.src WHERE e.template_id = k.template_id AND e.dst = k.name AND s.rtype = 'AWS::EC2::VPCGatewayAttachment')"),
    "route_table_no_default_route": ("MEDIUM", "rtype = 'AWS::EC2::RouteTable' AND EXISTS (FROM kind g WHERE g.template_id = k.template_id AND g.rtype = 'AWS::EC2::InternetGateway') AND NOT EXISTS (FROM edge e JOIN kind s ON s.template_id = e.template_id AND s.name = e.src JOIN node n ON n.template_id = e.template_id AND n.path = '$.Resources.' || e.src || '.Properties' AND n.key IN ('DestinationCidrBlock', 'DestinationIpv6CidrBlock') AND n.v IN ('0.0.0.0/0', '::/0') WHERE e.template_id = k.template_id AND e.dst = k.name AND s.rtype = 'AWS::EC2::Route')"),
    "rds_reachable_from_internet": ("HIGH", "rtype = 'AWS::RDS::DBInstance' AND EXISTS (FROM kind g WHERE g.template_id = k.template_id AND g.rtype = 'AWS::EC2::InternetGateway') AND EXISTS (FROM node n WHERE n.template_id = k.template_id AND n.path = '$.Resources.' || k.name || '.Properties' AND n.key = 'PubliclyAccessible' AND n.vtype = 'BOOLEAN' AND n.v = 'true')"),
    "orphaned_route_table": ("LOW", "rtype = 'AWS::EC2::RouteTable' AND NOT EXISTS (FROM edge e WHERE e.template_id = k.template_id AND e.dst = k.name)"),
}
_NETWORKS = " UNION ALL ".join(f"SELECT template_id, name AS resource, '{r}' AS rule_id, '{s}' AS severity, 'NetworkSecurity' AS category, 'Security' AS type FROM kind k WHERE {c}" for r, (s, c) in _NETWORK.items())


@sql(f"WITH {_WHOLE} SELECT * FROM ({_NETWORKS})")
def review_network_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over the graph of a template's network."""
    return _raw(spark, sf_dir, "templates", "network")


_WITHIN = "(regexp_matches(fullkey, '^\\$\\.(Conditions|Outputs)\\.') OR regexp_matches(fullkey, '^\\$\\.Resources\\.[A-Za-z0-9]+\\.Properties'))"
_ENVIRONMENT = "CASE WHEN regexp_matches(c.name, '(?i)is[_-]?prod(uction)?\\b') THEN 'prod' WHEN regexp_matches(c.name, '(?i)is[_-]?stag(ing|e)?\\b') THEN 'stag' WHEN regexp_matches(c.name, '(?i)is[_-]?dev(elopment)?\\b') THEN 'dev' WHEN regexp_matches(c.name, '(?i)is[_-]?test\\b') THEN 'test' END"
_QUALITY = f"""used AS (SELECT template_id, v AS name FROM node WHERE vtype = 'VARCHAR' AND regexp_matches(fullkey, '^\\$\\.(Resources|Conditions|Outputs)\\.') AND (key = 'Ref' OR fullkey LIKE '%"Fn::GetAtt"[0]')
   UNION ALL SELECT template_id, split_part(unnest(regexp_extract_all(v, '\\$\\{{([A-Za-z0-9:._-]+)\\}}', 1)), '.', 1) FROM node WHERE fullkey LIKE '%"Fn::Sub"'),
 param AS (SELECT template_id, key AS name, fullkey FROM node WHERE path = '$.Parameters'),
 cond AS (SELECT template_id, key AS name, fullkey FROM node WHERE path = '$.Conditions'),
 named AS (SELECT template_id, v AS name FROM node WHERE vtype = 'VARCHAR' AND (regexp_matches(fullkey, '^\\$\\.Resources\\.[A-Za-z0-9]+\\.Condition$') OR {_WITHIN} AND (key = 'Condition' OR fullkey LIKE '%"Fn::If"[0]'))),
 equal AS (SELECT c.template_id, c.name, {_ENVIRONMENT} AS env, (SELECT lower(arg_min(o.v, o.id)) FROM node o WHERE o.template_id = c.template_id AND o.path = c.fullkey || '."Fn::Equals"' AND o.vtype = 'VARCHAR') AS said,
   (SELECT count(*) FROM node o WHERE o.template_id = c.template_id AND o.path = c.fullkey || '."Fn::Equals"') AS n FROM cond c),
 walk(template_id, way, ranks, closed) AS (SELECT template_id, [name], [(0, id)], false FROM res
   UNION ALL SELECT w.template_id, list_append(way, e.dst), list_append(ranks, (e.rank[1], e.rank[2])), list_contains(way, e.dst) FROM walk w JOIN edge e ON e.template_id = w.template_id AND e.src = w.way[len(w.way)] WHERE NOT closed),
 ring AS (SELECT template_id, arg_min(way, ranks) AS way FROM walk WHERE closed GROUP BY template_id),
 e(template_id, resource, rule_id, severity, category, type) AS (
   SELECT template_id, name, 'condition_name_logic_mismatch', 'MEDIUM', 'Other', 'BestPractice' FROM equal WHERE n = 2 AND env IS NOT NULL AND NOT contains(said, env) AND len(list_filter(['prod', 'stag', 'dev', 'test'], lambda x: x <> env AND contains(said, x))) > 0
   UNION ALL SELECT template_id, name, 'unused_parameter', 'LOW', 'Other', 'BestPractice' FROM param p WHERE NOT EXISTS (FROM used u WHERE u.template_id = p.template_id AND u.name = p.name)
   UNION ALL SELECT template_id, name, 'unused_condition', 'LOW', 'Other', 'BestPractice' FROM cond c WHERE NOT EXISTS (FROM named u WHERE u.template_id = c.template_id AND u.name = c.name)
   UNION ALL SELECT template_id, way[len(way)], 'circular_dependency', 'HIGH', 'Other', 'Validity' FROM ring
   UNION ALL SELECT template_id, name, 'allowed_values_mixed_types', 'LOW', 'Other', 'BestPractice' FROM param p WHERE (SELECT count(DISTINCT vtype = 'VARCHAR') FROM node n WHERE n.template_id = p.template_id AND n.path = p.fullkey || '.AllowedValues') = 2)"""


@sql(f"WITH RECURSIVE {_WHOLE}, {_QUALITY} SELECT * FROM e")
def review_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over parameters, conditions and dependencies."""
    return _raw(spark, sf_dir, "templates", "quality")


@sql(
    f"""WITH {_WHOLE}, held AS (SELECT template_id, regexp_extract(fullkey, '^\\$\\.Resources\\.([A-Za-z0-9]+)', 1) AS resource, fullkey AS name, v FROM node
      WHERE vtype = 'VARCHAR' AND (regexp_matches(fullkey, '\\.Properties\\.Environment\\.Variables\\.[A-Za-z_]+$') OR contains(fullkey, '.Properties.UserData'))
      UNION ALL SELECT template_id, regexp_extract(fullkey, '^\\$\\.Parameters\\.([A-Za-z0-9]+)', 1), regexp_extract(fullkey, '^\\$\\.Parameters\\.([A-Za-z0-9]+)', 1), v FROM node WHERE regexp_matches(fullkey, '^\\$\\.Parameters\\.[A-Za-z0-9]+\\.Default$')),
    bits AS (SELECT *, (SELECT -sum(n * 1.0 / length(v) * log2(n * 1.0 / length(v))) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(v, '')) AS c) GROUP BY c)) AS entropy FROM held)
    SELECT DISTINCT template_id, resource, 'plaintext_secret' AS rule_id, 'HIGH' AS severity, 'DataProtection' AS category, 'Security' AS type FROM bits
    WHERE NOT regexp_matches(v, 'EXAMPLE|example|changeme|CHANGEME|your-|YOUR-') AND (regexp_matches(v, '(^|[^A-Za-z0-9])AKIA[A-Z0-9]{{16}}($|[^A-Za-z0-9])') OR regexp_matches(lower(name), 'password|passwd|secret|token|api_?key') AND length(v) >= 12 AND NOT contains(v, ' ') AND entropy >= 3.5)"""
)
def review_secret_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of secrets in plain text."""
    return _raw(spark, sf_dir, "templates", "secrets")


_DOCS = ", ".join("({}, {})".format(i, "NULL" if e is None else "'" + e.replace("'", "''") + "'") for i, (_, e) in enumerate(made.DOCUMENTS))
#: Of the documents that are read: how many nodes each has, and how many of them stand under a repeated key.
_SIZES = {0: (4, 0), 1: (4, 0), 2: (1, 0), 3: (3, 1), 4: (6, 0), 5: (8, 0), 6: (7, 0)}
_READ = ", ".join(f"({i}, {n}, {d})" for i, (n, d) in _SIZES.items())


@sql(f"SELECT template_id, w.error, n.nodes, n.repeated FROM ({made.sql('documents')}) t JOIN (VALUES {_DOCS}) w(variant, error) USING (variant) LEFT JOIN (VALUES {_READ}) n(variant, nodes, repeated) USING (variant)")
def review_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are read, with their nodes and those under repeated keys, and those that are refused, with why."""
    known = [e for _, e in made.DOCUMENTS if e]
    table = nodes(made.templates(spark, sf_dir, "documents"))
    why = F.coalesce(*[F.when(F.startswith("error", F.lit(e)), e) for e in dict.fromkeys(known)], "error")
    read = F.col("vtype") != "error"
    return table.groupBy("template_id").agg(F.max(why).alias("error"), F.when(F.bool_and(read), F.count("*")).alias("nodes"), F.when(F.bool_and(read), F.count_if("dup_key")).alias("repeated"))


_SOURCES = {"parts": "cfn-guard", "policies": "IAM Review"}
_RANK = "list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)"
_KIND = "list_position(['Informational', 'BestPractice', 'Validity', 'Security'], type)"
_MERGED = f"""m AS (SELECT template_id, resource, category, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max({_RANK})] AS severity, ['Informational', 'BestPractice', 'Validity', 'Security'][max({_KIND})] AS type, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_id
   FROM r GROUP BY template_id, resource, category)"""


@sql(f"WITH {_PARTS}, r AS (SELECT * FROM ({_PROPERTY})), {_MERGED} SELECT template_id, resource, category, severity, type, rule_id, 'cfn-guard' AS source FROM m")
def review_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings merged by resource and category."""
    raw = Review(made.templates(spark, sf_dir, "parts"), ("properties",)).raw()
    return findings.merged(settled(raw)).select("template_id", "resource", "category", "severity", "type", "rule_id", "source")


@sql(
    f"""WITH {_PARTS}, r AS (SELECT * FROM ({_PROPERTY})), {_MERGED}
    SELECT t.template_id, count(m.template_id) AS total, {', '.join(f"count(*) FILTER (m.severity = '{s}') AS n_{s.lower()}" for s in findings.SEVERITIES)},
      {', '.join(f"count(*) FILTER (m.type = '{k}') AS n_{k.lower()}" for k in findings.TYPES)}, count(m.template_id) = 0 AS passed, CASE WHEN count(*) FILTER (m.severity IN ('HIGH', 'CRITICAL')) > 0 THEN 1 ELSE 0 END AS exit_status
    FROM (SELECT DISTINCT template_id FROM t) t LEFT JOIN m ON m.template_id = t.template_id GROUP BY t.template_id"""
)
def review_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a template's merged findings by severity and type, zeros told, whether it passes, and the exit status of a gate."""
    templates = made.templates(spark, sf_dir, "parts")
    merged = findings.merged(settled(Review(templates, ("properties",)).raw()))
    return findings.summaries(merged, templates.select("template_id"))


# Two versions of a template, by path.
_PATH = "list_transform(regexp_extract_all(n.fullkey, '\\.\"[^\"]*\"|\\.[A-Za-z0-9_]+|\\[[0-9]+\\]'), lambda x: trim(x, '.\"[]'))"
_SIDE = "SELECT template_id, {path} AS path, n.type AS t, CASE WHEN n.type IN ('OBJECT', 'ARRAY') THEN NULL ELSE CAST(n.value AS VARCHAR) END AS v FROM ({rows}) q, json_tree(q.body::JSON) n"
_ENTRY = "path[1] IN ('Resources', 'Parameters', 'Conditions', 'Outputs', 'Mappings')"
_VERSIONS = f"""b AS ({_SIDE.format(path=_PATH, rows=made.sql('base'))}), h AS ({_SIDE.format(path=_PATH, rows=made.sql('head'))}),
 o AS (SELECT template_id, path, b.t AS bt, b.v AS bv, h.t AS ht, h.v AS hv FROM b FULL JOIN h USING (template_id, path)),
 turned AS (SELECT o.template_id, o.path[1:2] AS owner FROM o WHERE len(o.path) = 3 AND o.path[1] = 'Resources' AND o.path[3] = 'Type' AND o.bv IS DISTINCT FROM o.hv
   AND EXISTS (FROM o x WHERE x.template_id = o.template_id AND x.path = o.path[1:2] AND x.bt = 'OBJECT' AND x.ht = 'OBJECT')),
 u AS (SELECT DISTINCT o.template_id, CASE WHEN NOT {_ENTRY} THEN path[1:1] WHEN t.owner IS NOT NULL THEN t.owner WHEN path[1] = 'Resources' AND len(path) > 2 AND path[3] NOT IN ('Type', 'Properties', 'DependsOn', 'Condition', 'DeletionPolicy', 'UpdateReplacePolicy', 'UpdatePolicy', 'CreationPolicy', 'Metadata') THEN path[1:3] ELSE path END AS path, t.owner IS NOT NULL AS type_changed
   FROM o LEFT JOIN turned t ON t.template_id = o.template_id AND t.owner = o.path[1:2] WHERE bt IS DISTINCT FROM ht OR bv IS DISTINCT FROM hv),
 k AS (SELECT u.*, CASE WHEN o.bt IS NULL THEN 'added' WHEN o.ht IS NULL THEN 'removed' ELSE 'modified' END AS change FROM u JOIN o USING (template_id, path) WHERE NOT EXISTS (FROM u x WHERE x.template_id = u.template_id AND len(x.path) < len(u.path) AND x.path = u.path[1:len(x.path)])),
 pre AS (SELECT DISTINCT template_id FROM o WHERE path[1] = 'Transform'),
 near AS (SELECT k.template_id, k.path, bool_or(len(o.path) > 2 AND (o.path[-1] = 'Ref' OR starts_with(o.path[-1], 'Fn::'))) AS expression, bool_or(contains(coalesce(o.bv, ''), '{{{{resolve:') OR contains(coalesce(o.hv, ''), '{{{{resolve:')) AS dyn,
   bool_or(len(o.path) > 2 AND (o.path[-1] IN ('Fn::GetAZs', 'Fn::ImportValue') OR o.path[-1] = 'Ref' AND (starts_with(coalesce(o.bv, ''), '"AWS::') OR starts_with(coalesce(o.hv, ''), '"AWS::')))) AS ext
   FROM k JOIN o ON o.template_id = k.template_id AND o.path[1:len(k.path)] = k.path GROUP BY ALL),
 c AS (SELECT k.*, array_to_string(list_filter([CASE WHEN n.expression OR {_ENTRY} AND len(list_filter(k.path[3:], lambda x: x = 'Ref' OR starts_with(x, 'Fn::'))) > 0 THEN 'expression_unevaluated' END,
   CASE WHEN {_ENTRY} AND list_contains(k.path[3:], 'Fn::If') OR EXISTS (FROM o x WHERE x.template_id = k.template_id AND x.path[1:2] = k.path[1:2] AND len(x.path) = 3 AND x.path[3] = 'Condition' AND x.path[1] IN ('Resources', 'Outputs')) THEN 'conditional' END,
   CASE WHEN n.dyn THEN 'dynamic_reference_unresolved' END, CASE WHEN n.ext OR {_ENTRY} AND len(list_filter(k.path[3:], lambda x: x IN ('Fn::GetAZs', 'Fn::ImportValue'))) > 0 THEN 'external_value' END,
   CASE WHEN k.template_id IN (FROM pre) THEN 'pre_transform' END], lambda x: x IS NOT NULL), ',') AS qualifiers FROM k LEFT JOIN near n USING (template_id, path)),
 ends AS (SELECT k.template_id, k.path, k.change, coalesce(o.bv, o.hv) AS rtype FROM k JOIN o ON o.template_id = k.template_id AND o.path = list_append(k.path, 'Type') WHERE len(k.path) = 2 AND k.path[1] = 'Resources' AND change <> 'modified')"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(settled(nodes(made.templates(spark, sf_dir, side))) for side in ("base", "head"))


@sql(
    f"""WITH {_VERSIONS} SELECT template_id, path[1] AS section, array_to_string(path, '/') AS path, change, type_changed, qualifiers,
      CASE WHEN EXISTS (FROM ends e JOIN ends f ON f.template_id = e.template_id AND f.rtype = e.rtype AND f.change <> e.change WHERE e.template_id = c.template_id AND e.path = c.path) THEN 'possible_logical_id_rename' END AS hint, false AS failed FROM c"""
)
def review_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two versions of templates, with qualifiers and hints."""
    return semantic.changes(*_versions(spark, sf_dir)).withColumn("path", F.array_join("path", "/"))


@sql(
    f"""WITH {_VERSIONS}, l AS (SELECT DISTINCT template_id, 'transform_not_expanded' AS x FROM pre UNION SELECT template_id, 'nested_stack_not_compared' FROM o WHERE path[-1] = 'Type' AND '"AWS::CloudFormation::Stack"' IN (bv, hv)
      UNION SELECT template_id, 'dynamic_reference_unresolved' FROM o WHERE contains(coalesce(bv, '') || coalesce(hv, ''), '{{{{resolve:') UNION SELECT template_id, 'indirect_effects_not_evaluated' FROM c WHERE path[1] IN ('Parameters', 'Mappings', 'Conditions'))
    SELECT t.template_id, count(c.path) AS total, count(*) FILTER (c.change = 'added') AS n_added, count(*) FILTER (c.change = 'removed') AS n_removed, count(*) FILTER (c.change = 'modified') AS n_modified,
      coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM l WHERE l.template_id = t.template_id), '') AS limitations FROM (SELECT DISTINCT template_id FROM o) t LEFT JOIN c ON c.template_id = t.template_id GROUP BY t.template_id"""
)
def review_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of changes and limitations of each comparison."""
    base, head = _versions(spark, sf_dir)
    limits = settled(semantic.limitations(base, head))
    return semantic.summary(semantic.changes(base, head, limits=limits), limits, made.templates(spark, sf_dir, "base"))


# Facts: references in all of a resource, parameters, availability, statistics.
_TOKENS = "regexp_extract_all({}, '\\$\\{{([A-Za-z0-9:._-]+)\\}}', 1)"
_FACTS = f"""t AS ({made.sql('templates')}),
 node AS (SELECT template_id, n.id, n.key, {_PATH} AS path, n.type AS vtype, CASE WHEN n.type = 'VARCHAR' THEN json_extract_string(n.value, '$') ELSE CAST(n.value AS VARCHAR) END AS v FROM t, json_tree(t.body::JSON) n),
 own AS (SELECT *, path[2] AS src FROM node WHERE path[1] = 'Resources' AND len(path) > 2),
 named AS (SELECT template_id, src, path[1:-2] AS spot, unnest({_TOKENS.format('v')}) AS name FROM own WHERE path[-1] = 'Fn::Sub' AND vtype = 'VARCHAR'
   UNION ALL SELECT template_id, src, path[1:-3], unnest({_TOKENS.format('v')}) FROM own WHERE path[-2] = 'Fn::Sub' AND path[-1] = '0' AND vtype = 'VARCHAR'),
 refs AS (SELECT DISTINCT template_id, src, dst, kind, attribute, array_to_string(spot, '/') AS place FROM (
   SELECT template_id, src, v AS dst, 'Ref' AS kind, NULL AS attribute, path[1:-2] AS spot FROM own WHERE path[-1] = 'Ref' AND vtype = 'VARCHAR'
   UNION ALL SELECT template_id, src, split_part(v, '.', 1), 'Fn::GetAtt', nullif(regexp_extract(v, '^[^.]*\\.(.*)$', 1), ''), path[1:-2] FROM own WHERE path[-1] = 'Fn::GetAtt' AND vtype = 'VARCHAR'
   UNION ALL SELECT template_id, src, arg_min(v, id), 'Fn::GetAtt', nullif(array_to_string((list(v ORDER BY id))[2:], '.'), ''), path[1:-3] FROM own WHERE path[-2] = 'Fn::GetAtt' AND vtype = 'VARCHAR' GROUP BY template_id, src, path[1:-3]
   UNION ALL SELECT template_id, src, split_part(name, '.', 1), 'Fn::Sub', nullif(regexp_extract(name, '^[^.]*\\.(.*)$', 1), ''), spot FROM named n
     WHERE NOT EXISTS (FROM own s WHERE s.template_id = n.template_id AND len(s.path) = len(n.spot) + 3 AND s.path[1:-4] = n.spot AND s.path[-3] = 'Fn::Sub' AND s.path[-2] = '1' AND s.path[-1] IN (n.name, split_part(n.name, '.', 1)))))"""


def _relations(spark: SparkSession, sf_dir: str, kind: str) -> Relations:
    return Relations(settled(nodes(made.templates(spark, sf_dir, kind))))


@sql(f"WITH {_FACTS} SELECT * FROM refs r WHERE src <> dst AND EXISTS (FROM own o WHERE o.template_id = r.template_id AND o.src = r.dst)")
def facts_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between resources with their attributes and places."""
    return facts.resource_references(_relations(spark, sf_dir, "templates"))


@sql(
    f"""WITH {_FACTS}, p AS (SELECT template_id, path[2] AS name, max(v) FILTER (path[3] = 'Type') AS type, coalesce(bool_or(path[3] = 'NoEcho' AND lower(trim(v)) = 'true'), false) AS no_echo, max(v) FILTER (path[3] = 'Default') AS d FROM node WHERE path[1] = 'Parameters' AND len(path) = 3 GROUP BY ALL)
    SELECT template_id, name, type, no_echo, CASE WHEN no_echo AND d IS NOT NULL THEN '[REDACTED]' ELSE d END AS default_value, coalesce((SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM refs r WHERE r.template_id = p.template_id AND r.dst = p.name), '') AS referenced_by FROM p"""
)
def facts_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters, their defaults hidden where they must not be shown, and who refers to them."""
    return facts.parameters(_relations(spark, sf_dir, "templates"))


@sql(f"WITH {_FACTS} SELECT template_id, src AS resource, array_to_string(path, '/') AS place FROM own WHERE path[-1] IN ({', '.join(map(repr, facts.AVAILABILITY))})")
def facts_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where resources speak of availability."""
    return facts.availability(_relations(spark, sf_dir, "templates"))


@sql(f"WITH {_POLICY}(SELECT NULL, NULL, NULL, NULL) SELECT template_id, count(DISTINCT doc) AS documents, count(*) AS statements, count(*) FILTER (lower(trim(json_extract_string(s, '$.Effect'))) = 'allow') AS allowing FROM stmt GROUP BY template_id")
def facts_policy_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many policies and statements each template has."""
    return facts.policy_statistics(_relations(spark, sf_dir, "policies"))


_DUE = ", ".join(f"('{r}', 'AWS::{t}')" for r, t, *_ in _RULES)


@sql(
    f"""WITH {_PARTS}, r AS (SELECT * FROM ({_PROPERTY})), n AS (SELECT count(DISTINCT rule_id) AS n FROM (VALUES {_DUE}) v(rule_id, rtype))
    SELECT template_id, count(DISTINCT v.rule_id) AS evaluated, (SELECT count(DISTINCT rule_id) FROM r WHERE r.template_id = t.template_id) AS failing, (SELECT n FROM n) - count(DISTINCT v.rule_id) AS not_applicable
    FROM t LEFT JOIN (VALUES {_DUE}) v(rule_id, rtype) USING (rtype) GROUP BY template_id"""
)
def facts_rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many property rules were tested, failed or had nothing to test, by template."""
    return facts.rule_statistics(_relations(spark, sf_dir, "parts"))


#: What a contract lets change: the resource A, a queue, its property X by replacing, Y by adding.
_SCOPE = """c.path[1] = 'Resources' AND c.path[2] = 'A'"""


@sql(
    f"""WITH {_VERSIONS}, w AS (SELECT c.*, {_SCOPE} AS inside, c.path[1] = 'Resources' AND len(c.path) = 2 AS whole, c.path[4] AS prop, c.path[1:4] AS spot FROM c),
     x AS (SELECT w.*, o.bt IS NOT NULL AND o.ht IS NOT NULL AS kept, o.ht IS NOT NULL AS there, EXISTS (FROM o i WHERE i.template_id = w.template_id AND len(i.path) > 4 AND i.path[1:4] = w.spot AND i.path[-1] = 'Fn::If') AS gated FROM w LEFT JOIN o ON o.template_id = w.template_id AND o.path = w.spot),
     y AS (SELECT *, CASE WHEN whole AND type_changed THEN 'resource_type_changed' WHEN whole AND change = 'added' THEN 'resource_added' WHEN whole AND change = 'removed' THEN 'resource_removed' WHEN whole AND inside THEN 'parent_replaced' WHEN whole OR NOT inside THEN 'template_change_outside_scope'
       WHEN len(path) = 3 AND path[3] = 'Properties' THEN 'parent_replaced' WHEN len(path) < 4 OR path[3] <> 'Properties' OR prop NOT IN ('X', 'Y') THEN 'template_change_outside_scope'
       WHEN NOT CASE prop WHEN 'X' THEN kept ELSE there AND NOT kept END THEN 'operation_not_allowed' WHEN gated OR regexp_matches(qualifiers, 'conditional|dynamic_reference_unresolved|external_value|pre_transform') THEN 'unsupported_construct' END AS code FROM x)
    SELECT DISTINCT template_id, code, array_to_string(CASE WHEN code IN ('operation_not_allowed', 'unsupported_construct') THEN spot ELSE path END, '/') AS path FROM y WHERE code IS NOT NULL
    UNION SELECT template_id, 'unsupported_construct', '' FROM pre
    UNION SELECT DISTINCT template_id, 'target_resource_missing', 'Resources/A' FROM b WHERE NOT EXISTS (FROM b x WHERE x.template_id = b.template_id AND x.path = ['Resources', 'A', 'Type'] AND x.v = '"AWS::SQS::Queue"')"""
)
def review_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where changes leave what a contract allows."""
    base, head = _versions(spark, sf_dir)
    templates = made.templates(spark, sf_dir, "base").select("template_id")
    contracts = templates.select("template_id", F.lit("A").alias("resource"), F.lit("AWS::SQS::Queue").alias("type"))
    edits = templates.select("template_id", F.explode(F.array(F.struct(F.lit("X").alias("property"), F.array(F.lit("replace")).alias("operations")), F.struct(F.lit("Y").alias("property"), F.array(F.lit("add")).alias("operations")))).alias("e")).select("template_id", "e.*")
    return semantic.boundary(settled(semantic.changes(base, head)), base, head, semantic.limitations(base, head), semantic.uncompared(base, head), contracts, edits)
