from oracle.features import STEPS as FEATURE_STEPS
from oracle.base import with_ctes
from oracle.value import STEPS as VALUE_STEPS, over

PERSONS = {n: "SELECT count(*) FROM features" for n in ("features", "segments", "retention")} | {
    n: "SELECT count(*) FROM model" for n in ("predictions", "attributions")}
ROWS = " UNION ALL ".join(f"SELECT '{n}' AS artifact, ({q}) AS rows" for n, q in PERSONS.items())

SQL = {
    "k9_chain_counts": with_ctes("po item rev pay sale", ROWS, **{**FEATURE_STEPS, **VALUE_STEPS}),
    "a10_scored_file": over("""SELECT count(*) AS input_rows,
        count(*) FILTER (WHERE CAST(customer_unique_id AS VARCHAR) NOT LIKE '%7') AS scored_rows,
        count(*) FILTER (WHERE CAST(customer_unique_id AS VARCHAR) LIKE '%7') AS rejected_rows,
        count(*) FILTER (WHERE CAST(customer_unique_id AS VARCHAR) NOT LIKE '%7') AS valid_predictions FROM model"""),
}
