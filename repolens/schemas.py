"""The tables: a row per source file with its nested summary, and a row per project with its categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Names of fields, which stored data and model answers bear.
FUNCTION = "STRUCT<name: STRING, purpose: STRING, parameters: ARRAY<STRUCT<name: STRING, type: STRING>>, returnType: STRING, cyclomaticComplexity: DOUBLE, linesOfCode: DOUBLE, codeSmells: ARRAY<STRING>>"
STORED = "STRUCT<name: STRING, objectType: STRING, purpose: STRING, complexity: STRING, complexityReason: STRING, linesOfCode: DOUBLE>"
SUMMARY = f"""STRUCT<
  namespace: STRING, name: STRING, kind: STRING, purpose: STRING, implementation: STRING,
  internalReferences: ARRAY<STRING>, externalReferences: ARRAY<STRING>,
  publicConstants: ARRAY<STRUCT<name: STRING, value: STRING, type: STRING>>,
  publicFunctions: ARRAY<{FUNCTION}>,
  codeQualityMetrics: STRUCT<totalFunctions: DOUBLE, averageComplexity: DOUBLE, maxComplexity: DOUBLE, averageFunctionLength: DOUBLE, fileSmells: ARRAY<STRING>>,
  dependencies: ARRAY<STRUCT<name: STRING, groupId: STRING, version: STRING, scope: STRING>>,
  scheduledJobs: ARRAY<STRUCT<jobName: STRING, trigger: STRING, purpose: STRING>>,
  storedProcedures: ARRAY<{STORED}>, triggers: ARRAY<{STORED}>,
  tables: ARRAY<STRUCT<name: STRING, command: STRING>>, dataInputFields: ARRAY<STRUCT<name: STRING, type: STRING, description: STRING>>,
  databaseIntegration: STRUCT<mechanism: STRING, name: STRING, description: STRING, databaseName: STRING, tablesAccessed: ARRAY<STRING>, operationType: ARRAY<STRING>, queryPatterns: STRING, transactionHandling: STRING, codeExample: STRING>,
  integrationPoints: ARRAY<STRUCT<mechanism: STRING, name: STRING, description: STRING, path: STRING, method: STRING, direction: STRING>>,
  jspMetrics: STRUCT<scriptletCount: BIGINT, expressionCount: BIGINT, declarationCount: BIGINT, customTags: ARRAY<STRUCT<prefix: STRING, uri: STRING>>>,
  uiFramework: STRUCT<name: STRING, version: STRING, configFile: STRING>>"""
SOURCES = f"projectName STRING, filename STRING, filepath STRING, fileExtension STRING, canonicalType STRING, linesCount BIGINT, isCode BOOLEAN, summary {SUMMARY}, summaryError STRING, summaryVector ARRAY<FLOAT>, content STRING, contentVector ARRAY<FLOAT>, llmCapture STRUCT<completionModel: STRING, embeddingModel: STRING, capturedAt: TIMESTAMP>"
NAMED = "STRUCT<name: STRING, description: STRING>"
AGGREGATE = f"STRUCT<name: STRING, description: STRING, repository: {NAMED}, entities: ARRAY<{NAMED}>>"
APP_SUMMARIES = f"""projectName STRING, llmModels STRING, appDescription STRING, technologies ARRAY<{NAMED}>,
  businessProcesses ARRAY<STRUCT<name: STRING, description: STRING, keyBusinessActivities: ARRAY<STRUCT<activity: STRING, description: STRING>>>>,
  boundedContexts ARRAY<STRUCT<name: STRING, description: STRING, aggregates: ARRAY<{AGGREGATE}>>>,
  potentialMicroservices ARRAY<STRUCT<name: STRING, description: STRING, entities: ARRAY<STRUCT<name: STRING, description: STRING, attributes: ARRAY<STRING>>>, endpoints: ARRAY<STRUCT<path: STRING, method: STRING, description: STRING>>, operations: ARRAY<STRUCT<operation: STRING, method: STRING, description: STRING>>>>,
  inferredArchitecture ARRAY<STRUCT<internalComponents: ARRAY<{NAMED}>, externalDependencies: ARRAY<STRUCT<name: STRING, type: STRING, description: STRING>>, dependencies: ARRAY<STRUCT<`from`: STRING, `to`: STRING, description: STRING>>>>"""
#: Categories of a project's summary in the order of reports.
CATEGORIES = ("technologies", "businessProcesses", "boundedContexts", "potentialMicroservices", "inferredArchitecture")

#: Fields of a summary that are asked for, by file type; other types get the last entry.
CODE_FIELDS = ("name", "kind", "namespace", "purpose", "implementation", "internalReferences", "externalReferences", "publicConstants", "publicFunctions", "databaseIntegration", "integrationPoints", "codeQualityMetrics")
SUMMARY_FIELDS = {t: CODE_FIELDS for t in ("java", "javascript", "csharp", "python", "ruby", "c", "cpp")}
SUMMARY_FIELDS |= {t: ("name", "purpose", "implementation", "dependencies") for t in ("maven", "gradle", "ant", "npm", "dotnet-proj", "nuget", "ruby-bundler", "python-pip", "python-setup", "python-poetry", "makefile")}
SUMMARY_FIELDS |= {t: ("purpose", "implementation", "scheduledJobs") for t in ("shell-script", "batch-script", "jcl")}
SUMMARY_FIELDS |= {
    "sql": ("purpose", "implementation", "tables", "storedProcedures", "triggers", "databaseIntegration"),
    "markdown": ("purpose", "implementation", "databaseIntegration"),
    "xml": ("purpose", "implementation", "uiFramework"),
    "jsp": ("purpose", "implementation", "internalReferences", "externalReferences", "dataInputFields", "jspMetrics"),
    "default": ("purpose", "implementation", "databaseIntegration"),
}


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def summary_type(spark: SparkSession, canonical_type: str) -> StructType:
    """The part of a summary that files of a type have."""
    whole = empty(spark, SOURCES).schema["summary"].dataType
    return StructType([whole[f] for f in SUMMARY_FIELDS.get(canonical_type, SUMMARY_FIELDS["default"])])
