"""Jobs made of the operators: summary views, training, evaluation, scoring."""
