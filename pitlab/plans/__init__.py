"""Reports composed from the operators, each as one lazy plan."""
