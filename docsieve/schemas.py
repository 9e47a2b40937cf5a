"""Declared table schemas, as DDL."""

from __future__ import annotations

# Tables that exist keep these columns, in this order.
AUDIT_SCHEMAS: dict[str, str] = {
    "pipeline_execution_log": """
        execution_id STRING NOT NULL,
        pipeline_name STRING NOT NULL,
        agent_name STRING,
        environment STRING NOT NULL,
        triggered_by STRING,
        trigger_source STRING,
        depends_on STRING,
        status STRING,
        start_time TIMESTAMP,
        end_time TIMESTAMP,
        duration_seconds DOUBLE,
        error_message STRING,
        databricks_job_id STRING,
        databricks_run_id STRING,
        databricks_task_key STRING
    """,
    "pipeline_step_log": """
        step_id STRING NOT NULL,
        execution_id STRING NOT NULL,
        step_name STRING NOT NULL,
        step_order INT,
        step_type STRING,
        depends_on STRING,
        status STRING,
        start_time TIMESTAMP,
        end_time TIMESTAMP,
        duration_seconds DOUBLE,
        records_processed BIGINT,
        input_params STRING,
        output_summary STRING,
        error_message STRING,
        databricks_job_run_id STRING
    """,
    "deployment_events": """
        event_id STRING NOT NULL,
        timestamp TIMESTAMP NOT NULL,
        agent_name STRING NOT NULL,
        agent_version STRING,
        source_environment STRING,
        target_environment STRING NOT NULL,
        deployed_by STRING,
        approved_by STRING,
        evaluation_passed BOOLEAN,
        evaluation_run_id STRING,
        jenkins_build_id STRING,
        commit_hash STRING,
        deployment_status STRING,
        error_message STRING
    """,
    "guardrail_audit_log": """
        audit_id STRING NOT NULL,
        timestamp TIMESTAMP NOT NULL,
        agent_name STRING NOT NULL,
        environment STRING NOT NULL,
        guardrail_type STRING,
        check_name STRING,
        blocked BOOLEAN,
        input_snippet STRING,
        reason STRING
    """,
    "eval_results": """
        evaluation_id STRING NOT NULL,
        execution_id STRING,
        row_index BIGINT,
        request STRING,
        response STRING,
        expected_response STRING,
        context STRING,
        scores MAP<STRING, DOUBLE>,
        toxicity_score DOUBLE,
        accuracy_score DOUBLE,
        helpfulness_score DOUBLE,
        professionalism_score DOUBLE,
        docs_relevance_score DOUBLE,
        code_snippet_score DOUBLE,
        source_citation_score DOUBLE,
        answer_completeness_score DOUBLE,
        overall_passed BOOLEAN,
        agent_name STRING,
        agent_version STRING,
        environment STRING,
        evaluated_at TIMESTAMP
    """,
}

# One row per start or end of a run or step; states are folded from these.
EVENT_SCHEMA = """
    key STRING NOT NULL,
    event STRING,
    status STRING,
    ts TIMESTAMP,
    execution_id STRING,
    step_name STRING,
    step_order INT,
    depends_on STRING,
    records_processed BIGINT,
    input_params STRING,
    output_summary STRING,
    error_message STRING
"""

SESSION_SCHEMA = """
    turn_id STRING NOT NULL,
    session_id STRING NOT NULL,
    turn_number INT NOT NULL,
    user_message STRING,
    assistant_response STRING,
    request_time STRING NOT NULL,
    response_time_ms DOUBLE,
    model_endpoint STRING,
    trace_id STRING,
    metadata STRING
"""
