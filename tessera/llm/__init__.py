"""Operators for preparing text corpora; nothing else in the library imports this package."""

from pyspark import cloudpickle

import tessera

# functions that run on executors travel with their code: no executor needs the package on its path
cloudpickle.register_pickle_by_value(tessera)
