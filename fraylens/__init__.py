"""fraylens: combat-event analytics as Spark DataFrame operators."""
