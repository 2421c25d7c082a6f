"""Row types of the public tables."""
from pyspark.sql import types as T

from quarterdeck.config import PERIOD_FIELDS

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FACT = _struct(cik=_L, tag=_S, unit=_S, period_start=T.DateType(), period_end=T.DateType(), qtrs=_I, value=_D,
               form=_S, filed_date=T.DateType(), accession=_S, source=_S, load_seq=_L)
PERIOD = T.StructType([T.StructField("cik", _L), T.StructField("period_end", T.DateType()),
                       T.StructField("period_type", _S), *[T.StructField(f, _D) for f in PERIOD_FIELDS]])
COMPANY = _struct(cik=_L, ticker=_S, name=_S, sic=_S, sic_description=_S, exchange=_S, entity_type=_S,
                  fiscal_year_end=_S, filer_category=_S, state=_S, state_description=_S, is_active=_B,
                  first_seen=T.DateType(), last_updated=T.DateType())
LISTING = _struct(ticker=_S, exchange=_S, security_name=_S, is_etf=_B, is_test_issue=_B, financial_status=_S,
                  round_lot=_D)
MARKET = _struct(cik=_L, date=T.DateType(), price=_D, shares_outstanding=_D, market_cap=_D, volume=_D,
                 shares_basis=_S, load_seq=_L)
JOB_RUN = _struct(run_id=_S, job=_S, started_at=T.TimestampType(), finished_at=T.TimestampType(), status=_S,
                  stats=T.MapType(_S, _S), error=_S)
