"""flowlens: captured-traffic analytics as composable DataFrame operators."""
