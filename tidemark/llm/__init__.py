"""Operations of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the workers by value: those need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
