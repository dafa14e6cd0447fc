"""``python -m tastemill <command>``: see ``plans.experiment.command``."""

import sys

from pyspark.sql import SparkSession

from tastemill.plans.experiment import command

if __name__ == "__main__":
    print(command(SparkSession.builder.appName("tastemill").getOrCreate(), sys.argv[1:]))
