"""Sequence-mapping analytics as Spark jobs: seeding, verification, pairing and reporting of short reads."""
