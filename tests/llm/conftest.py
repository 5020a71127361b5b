import pytest

TASKS = (
    "line_no bigint, id string, domain string, source_record_id string, split string, user_language string, expected_answer_language string, user_query string, tool_result string, "
    "field_specs array<struct<path string, role string, value string, accepted_values array<string>, required boolean, requires_localization boolean, description string>>, form string"
)
PREDICTIONS = "pred_id bigint, id string, sample_id string, run_id string, method string, answer string, form string"


@pytest.fixture(scope="session")
def make(spark):
    """Makers of task and prediction tables from the columns a test cares about."""

    def tasks(rows):
        base = dict(line_no=None, id=None, domain="book", source_record_id=None, split="train", user_language=None, expected_answer_language=None, user_query=None, tool_result=None, field_specs=None, form="clash")
        full = [base | {"line_no": i} | r for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r.values()) for r in full], TASKS)

    def predictions(rows):
        base = dict(pred_id=None, id=None, sample_id=None, run_id="r", method=None, answer=None, form="clash")
        full = [base | {"pred_id": i} | r for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r.values()) for r in full], PREDICTIONS)

    return type("Make", (), {"tasks": staticmethod(tasks), "predictions": staticmethod(predictions)})
