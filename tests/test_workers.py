"""Python workers must not need this package on their path."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
from canopyframe.operators import density2d, pareto, regression
trees = spark.createDataFrame([("a", 13.0 + i, float(i % 7)) for i in range(30)],
                              "PLT_CN string, DIA double, y double")
sums, bins = pareto.pareto_sums(trees), pareto.two_part_sums(trees, taus=5)
assert pareto.fit_pareto(sums).count() == 1
assert pareto.fit_two_part(bins, taus=5, alphas=5).count() == 3
assert pareto.pareto_draws(sums, iterations=[1]).count() == 4
assert pareto.two_part_draws(bins, iterations=[1], taus=5, alphas=5).count() == 12
points = regression.complete_points(trees, "DIA", "y")
regression.with_p_values(regression.with_errors(regression.regression_sums(points))).collect()
assert regression.fitted_line(points, steps=3).filter("upper > lower").count() == 3
assert density2d.kernel_density(points, n=4).count() == 16
print("done")
"""


def test_functions_travel_by_value(tmp_path):
    script = tmp_path / "elsewhere.py"
    script.write_text(SCRIPT)
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True,
                         text=True, timeout=170)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]
