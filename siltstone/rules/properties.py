"""Rules over resource properties, as rows of one table.

A rule's clause names resource types, a property (with * for list places), a check and its argument. All clauses are
evaluated by one join of resources with clauses and one with the properties, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.templates import Relations

_P = "Properties/"
_TAGGED = (
    "S3::Bucket",
    "RDS::DBInstance",
    "EC2::Instance",
    "EC2::SecurityGroup",
    "EC2::Volume",
    "DynamoDB::Table",
    "Lambda::Function",
    "SNS::Topic",
    "SQS::Queue",
    "EC2::VPC",
    "EC2::Subnet",
)

# Rule, types, property, check, argument, severity, category, finding type.
# A property after ">" is only tested where the one before ">" is there.
_RULES = (
    ("s3_bucket_encryption", "S3::Bucket", "BucketEncryption", "exists", "", "HIGH", "Encryption", "Security"),
    ("rds_storage_encrypted", "RDS::DBInstance", "StorageEncrypted", "true", "", "HIGH", "Encryption", "Security"),
    ("ebs_volume_encrypted", "EC2::Instance", "BlockDeviceMappings/*/Ebs/Encrypted", "true", "", "HIGH", "Encryption", "Security"),
    ("sns_topic_encrypted", "SNS::Topic", "KmsMasterKeyId", "exists", "", "MEDIUM", "Encryption", "Security"),
    ("logs_group_encrypted", "Logs::LogGroup", "KmsKeyId", "exists", "", "MEDIUM", "Encryption", "Security"),
    ("sqs_queue_encrypted", "SQS::Queue", "KmsMasterKeyId", "exists", "", "MEDIUM", "Encryption", "Security"),
    ("dynamodb_encryption", "DynamoDB::Table", "SSESpecification", "exists", "", "MEDIUM", "Encryption", "Security"),
    ("dynamodb_encryption", "DynamoDB::Table", "SSESpecification/SSEEnabled", "true", "", "MEDIUM", "Encryption", "Security"),
    ("kinesis_encryption", "Kinesis::Stream", "StreamEncryption", "exists", "", "HIGH", "Encryption", "Security"),
    ("kinesis_encryption", "Kinesis::Stream", "StreamEncryption/EncryptionType", "in", "KMS", "HIGH", "Encryption", "Security"),
    ("redshift_encryption", "Redshift::Cluster", "Encrypted", "true", "", "HIGH", "Encryption", "Security"),
    ("elasticache_encryption", "ElastiCache::ReplicationGroup", "TransitEncryptionEnabled", "true", "", "HIGH", "Encryption", "Security"),
    ("elasticache_encryption", "ElastiCache::ReplicationGroup", "AtRestEncryptionEnabled", "true", "", "HIGH", "Encryption", "Security"),
    ("efs_encryption", "EFS::FileSystem", "Encrypted", "true", "", "HIGH", "Encryption", "Security"),
    ("s3_access_logging", "S3::Bucket", "LoggingConfiguration", "exists", "", "MEDIUM", "Logging", "Security"),
    ("cloudtrail_enabled", "CloudTrail::Trail", "IsLogging", "true", "", "HIGH", "Logging", "Security"),
    ("cloudtrail_enabled", "CloudTrail::Trail", "EnableLogFileValidation", "true", "", "HIGH", "Logging", "Security"),
    ("logs_retention_set", "Logs::LogGroup", "RetentionInDays", "exists", "", "LOW", "Logging", "Security"),
    ("alb_access_logging", "ElasticLoadBalancingV2::LoadBalancer", "LoadBalancerAttributes", "exists", "", "MEDIUM", "Logging", "Security"),
    ("vpc_dns_hostnames", "EC2::VPC", "EnableDnsHostnames", "true", "", "MEDIUM", "NetworkSecurity", "BestPractice"),
    ("s3_public_access_block", "S3::Bucket", "PublicAccessBlockConfiguration", "exists", "", "CRITICAL", "PublicAccess", "Security"),
    ("s3_public_access_block", "S3::Bucket", "PublicAccessBlockConfiguration>PublicAccessBlockConfiguration/BlockPublicAcls", "true", "", "CRITICAL", "PublicAccess", "Security"),
    ("s3_public_access_block", "S3::Bucket", "PublicAccessBlockConfiguration>PublicAccessBlockConfiguration/BlockPublicPolicy", "true", "", "CRITICAL", "PublicAccess", "Security"),
    ("s3_public_access_block", "S3::Bucket", "PublicAccessBlockConfiguration>PublicAccessBlockConfiguration/IgnorePublicAcls", "true", "", "CRITICAL", "PublicAccess", "Security"),
    ("s3_public_access_block", "S3::Bucket", "PublicAccessBlockConfiguration>PublicAccessBlockConfiguration/RestrictPublicBuckets", "true", "", "CRITICAL", "PublicAccess", "Security"),
    ("security_group_open_ingress", "EC2::SecurityGroup", "SecurityGroupIngress/*/CidrIp", "none", "0.0.0.0/0", "HIGH", "NetworkSecurity", "Security"),
    ("security_group_open_ingress", "EC2::SecurityGroup", "SecurityGroupIngress/*/CidrIpv6", "none", "::/0", "HIGH", "NetworkSecurity", "Security"),
    ("rds_publicly_accessible", "RDS::DBInstance", "PubliclyAccessible>PubliclyAccessible", "false", "", "CRITICAL", "PublicAccess", "Security"),
    ("ec2_imdsv2_required", "EC2::Instance", "MetadataOptions", "exists", "", "HIGH", "DataProtection", "Security"),
    ("ec2_imdsv2_required", "EC2::Instance", "MetadataOptions/HttpTokens", "in", "required", "HIGH", "DataProtection", "Security"),
    ("cloudfront_https", "CloudFront::Distribution", "DistributionConfig/DefaultCacheBehavior/ViewerProtocolPolicy", "in", "https-only,redirect-to-https", "HIGH", "PublicAccess", "Security"),
    ("rds_backup_retention", "RDS::DBInstance", "BackupRetentionPeriod", "exists", "", "MEDIUM", "Backup", "BestPractice"),
    ("rds_backup_retention", "RDS::DBInstance", "BackupRetentionPeriod>BackupRetentionPeriod", "at_least", "7", "MEDIUM", "Backup", "BestPractice"),
    ("rds_deletion_protection", "RDS::DBInstance", "DeletionProtection", "true", "", "HIGH", "Availability", "BestPractice"),
    ("rds_multi_az", "RDS::DBInstance", "MultiAZ", "true", "", "MEDIUM", "Availability", "BestPractice"),
    ("s3_versioning_enabled", "S3::Bucket", "VersioningConfiguration/Status", "in", "Enabled", "MEDIUM", "DataProtection", "BestPractice"),
    ("dynamodb_pitr", "DynamoDB::Table", "PointInTimeRecoverySpecification", "exists", "", "MEDIUM", "DataProtection", "BestPractice"),
    ("dynamodb_pitr", "DynamoDB::Table", "PointInTimeRecoverySpecification/PointInTimeRecoveryEnabled", "true", "", "MEDIUM", "DataProtection", "BestPractice"),
    ("lambda_dlq", "Lambda::Function", "DeadLetterConfig", "exists", "", "MEDIUM", "Availability", "BestPractice"),
    ("lambda_timeout", "Lambda::Function", "Timeout", "exists", "", "LOW", "Availability", "BestPractice"),
    ("asg_multi_az", "AutoScaling::AutoScalingGroup", "AvailabilityZones", "exists", "", "MEDIUM", "Availability", "BestPractice"),
    ("asg_multi_az", "AutoScaling::AutoScalingGroup", "AvailabilityZones/*", "several", "2", "MEDIUM", "Availability", "BestPractice"),
    ("ec2_ebs_optimized", "EC2::Instance", "EbsOptimized", "true", "", "LOW", "Availability", "BestPractice"),
    ("required_tags", "TAGGED", "Tags", "exists", "", "LOW", "Tagging", "BestPractice"),
    ("required_tags", "TAGGED", "Tags>Tags/*/Key", "some", "Environment", "LOW", "Tagging", "BestPractice"),
    ("required_tags", "TAGGED", "Tags>Tags/*/Key", "some", "Owner", "LOW", "Tagging", "BestPractice"),
    ("alb_https_only", "ElasticLoadBalancingV2::Listener", "DefaultActions/*/Type", "first_if_http", "redirect", "HIGH", "PublicAccess", "Security"),
)


def clauses() -> list[tuple]:
    """The table's rows: (clause, rule_id, rtype, given, prop, check, wanted, severity, category, type)."""
    out = []
    for n, (rule, types, prop, check, wanted, severity, category, kind) in enumerate(_RULES):
        given, _, tested = prop.rpartition(">")
        for t in _TAGGED if types == "TAGGED" else (types,):
            out.append((n, rule, f"AWS::{t}", _P + given if given else "", _P + tested, check, wanted, severity, category, kind))
    # the policy on a bucket's deletion stands beside its properties
    out.append((len(out), "s3_deletion_policy", "AWS::S3::Bucket", "", "DeletionPolicy", "exists", "", "HIGH", "Backup", "BestPractice"))
    return out


def findings(relations: Relations) -> DataFrame:
    """Findings of all clauses that fail, and of templates with a network and no flow log."""
    spark = relations.nodes.sparkSession
    table = F.broadcast(spark.createDataFrame(clauses(), "clause int, rule_id string, rtype string, given string, prop string, check string, wanted string, severity string, category string, type string"))
    due = relations.resources.select("template_id", "logical_id", F.col("type").alias("rtype")).join(table, "rtype")
    values = F.array_sort(F.collect_list(F.struct("ord", "vtype", "sval", "place")))
    held = relations.props.groupBy("template_id", "logical_id", "prop").agg(values.alias("values"))
    tested = due.join(held, ["template_id", "logical_id", "prop"], "left")
    there = held.select("template_id", "logical_id", F.col("prop").alias("given"), F.lit(True).alias("is_given"))
    # how many places of a list there are, each of which must hold what is tested below it
    listed = held.select("template_id", "logical_id", F.col("prop").alias("list"), F.size("values").alias("places"))
    protocol = relations.props.where("prop = 'Properties/Protocol'").groupBy("template_id", "logical_id").agg(F.max("sval").alias("protocol"))
    tested = tested.join(there, ["template_id", "logical_id", "given"], "left").join(protocol, ["template_id", "logical_id"], "left").where("given = '' or is_given")
    tested = tested.withColumn("list", F.regexp_extract("prop", r"^(.*/\*)/", 1)).join(listed, ["template_id", "logical_id", "list"], "left")
    v, w = F.coalesce("values", F.array().cast("array<struct<ord:bigint,vtype:string,sval:string,place:string>>")), F.col("wanted")
    n = F.size(v)
    boolean = lambda text: (n == 0) | F.exists(v, lambda x: (x["vtype"] != "bool") | (x["sval"] != text))
    at_least = F.exists(v, lambda x: F.coalesce(~x["vtype"].isin("int", "float") | (x["sval"].try_cast("double") < w.try_cast("double")), F.lit(True)))
    fails = (
        F.when(F.col("check") == "exists", n == 0)
        .when(F.col("check") == "true", boolean("true") | (n < F.coalesce("places", F.lit(0))))
        .when(F.col("check") == "false", boolean("false"))
        .when(F.col("check") == "in", (n == 0) | F.exists(v, lambda x: F.coalesce(~F.array_contains(F.split(w, ","), x["sval"]), F.lit(True))))
        .when(F.col("check") == "none", F.exists(v, lambda x: F.coalesce(x["sval"] == w, F.lit(False))))
        .when(F.col("check") == "some", ~F.exists(v, lambda x: F.coalesce(x["sval"] == w, F.lit(False))))
        .when(F.col("check") == "at_least", (n == 0) | at_least)
        .when(F.col("check") == "several", n < w.try_cast("int"))
        .when(F.col("check") == "first_if_http", (F.col("protocol") == "HTTP") & F.coalesce(F.get(F.filter(v, lambda x: x["place"] == F.replace("prop", F.lit("*"), F.lit("0"))), F.lit(0))["sval"] != w, F.lit(True)))
    )
    said = F.concat("rule_id", F.lit(": "), "prop", F.lit(" must pass "), "check", F.when(w != "", F.concat(F.lit(" "), w)).otherwise(""))
    found = tested.where(fails).select("template_id", F.col("logical_id").alias("resource"), "category", "type", "severity", F.lit("Confirmed").alias("confidence"), F.lit("cfn-guard").alias("source"), "rule_id", said.alias("finding"))
    kinds = relations.resources.groupBy("template_id").agg(F.bool_or(F.col("type") == "AWS::EC2::VPC").alias("vpc"), F.bool_or(F.col("type") == "AWS::EC2::FlowLog").alias("log"))
    unlogged = kinds.where("vpc and not coalesce(log, false)").join(relations.resources.where("type = 'AWS::EC2::VPC'"), "template_id")
    flow = unlogged.select("template_id", F.col("logical_id").alias("resource"), *[F.lit(x).alias(c) for c, x in (("category", "NetworkSecurity"), ("type", "Security"), ("severity", "MEDIUM"), ("confidence", "Confirmed"), ("source", "cfn-guard"), ("rule_id", "vpc_flow_logs"), ("finding", "vpc_flow_logs: the template has a VPC and no flow log"))])
    return found.unionByName(flow).unionByName(_open_policies(relations))


def _open_policies(relations: Relations) -> DataFrame:
    """Policies with a statement in a list that allows the action * on the resource *, both word for word."""
    policies = relations.resources.where("type in ('AWS::IAM::Policy', 'AWS::IAM::ManagedPolicy')").select("template_id", "logical_id")
    part = lambda n: F.regexp_extract("place", r"^(Properties/PolicyDocument/Statement/[0-9]+)/(Effect|Action|Resource)(?:/[0-9]+)?$", n)
    said = relations.props.select("template_id", "logical_id", part(1).alias("stmt"), part(2).alias("element"), "vtype", "sval").where("stmt != '' and vtype = 'str'")
    says = lambda element, text: F.bool_or((F.col("element") == element) & (F.col("sval") == text))
    open_ = said.groupBy("template_id", "logical_id", "stmt").agg((says("Effect", "Allow") & says("Action", "*") & says("Resource", "*")).alias("open")).where("open")
    hit = open_.select("template_id", "logical_id").distinct().join(policies, ["template_id", "logical_id"], "left_semi")
    fixed = (("category", "IAM"), ("type", "Security"), ("severity", "CRITICAL"), ("confidence", "Confirmed"), ("source", "cfn-guard"), ("rule_id", "iam_policy_no_star_star"), ("finding", "iam_policy_no_star_star: a statement allows every action on every resource"))
    return hit.select("template_id", F.col("logical_id").alias("resource"), *[F.lit(x).alias(c) for c, x in fixed])
