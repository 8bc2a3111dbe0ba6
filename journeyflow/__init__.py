"""journeyflow: customer-journey analytics on Spark DataFrames.

Every operator is a plain ``DataFrame -> DataFrame`` function. Sub-packages:

* ``sources``   readers, writers and the test-table bindings
* ``functions`` Column-level scalar and array helpers
* ``operators`` cleaning, journeys, snapshots, features, sampling, models, metrics, series
* ``plans``     the query catalogue (Spark query + independent DuckDB oracle per operator)
* ``streaming`` the event-time session operator
"""

from journeyflow.schema import JourneyCols, DEFAULT_COLS  # noqa: F401
from journeyflow.session import get_session, tune_session  # noqa: F401

__version__ = "0.1.0"
