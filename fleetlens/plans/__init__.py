"""Named queries over the driver tables, and the SQL that must give the same rows."""

from fleetlens.plans import detection, inventory, reporting, streams

TOPICS = [detection, reporting, inventory, streams]
ALL = {name: entry for topic in TOPICS for name, entry in topic.QUERIES.items()}
