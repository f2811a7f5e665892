"""Run-wide constants.

Every clock read of the original notebooks (current_date, current_timestamp)
is an explicit ``as_of`` parameter so results are reproducible; this is the
default used by tests and registered queries.
"""

import datetime as _dt

AS_OF = _dt.datetime(1999, 7, 1, 0, 0, 0)
AS_OF_DATE = AS_OF.date()
AS_OF_SQL = "1999-07-01 00:00:00"
