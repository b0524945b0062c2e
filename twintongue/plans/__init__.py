"""Engine, catalog, statements, recursion and Datalog: plan construction on the driver."""
