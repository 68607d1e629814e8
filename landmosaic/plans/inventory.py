"""All queries of the operator inventory; each module registers its own."""

from landmosaic.plans import chains, evaluation, quality, reference, scalar, scenes, shapes, storage

QUERIES, SQL = reference.QUERIES, reference.SQL
MODULES = (chains, evaluation, quality, reference, scalar, scenes, shapes, storage)
