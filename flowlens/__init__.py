"""flowlens: network-flow and intrusion-alert analytics on PySpark.

Everything is a DataFrame transformation; see the sub-packages:

* ``flowlens.functions``  column expressions (text, numbers, time, labels, alert texts)
* ``flowlens.sources``    readers, schema checks, writers
* ``flowlens.operators``  features, joins, alert analytics, sampling, evaluation, models
* ``flowlens.streaming``  incremental sync, live feeds, packet state
* ``flowlens.plans``      table views and the registered queries with their SQL twins
"""

from flowlens.session import configure

__all__ = ["configure"]
